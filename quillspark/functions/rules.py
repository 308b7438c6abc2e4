"""Ordered rulebooks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of the ceremonial rules (Java syntax), in the order in which they are tried.
CEREMONIAL = {
    "veto": [
        r"(?iu)\b(?:tariff|Harmonized\s+Tariff\s+Schedule|HTSUS|duty[- ]free|trade\s+agreement|column\s+\d+\s+(?:general|special)\s+rate|import\s+quota|Generalized\s+System\s+of\s+Preferences|GSP\b)\b",
        r"(?iu)\b(?:suspend(?:s|ed)?\s+entry|nonimmigrant|declar\w+\s+(?:a\s+)?national\s+emergency)\b",
    ],
    "memorial_half_staff": r"(?iu)\bhalf[- ]?(?:staff|mast)\b",
    "symbol_design": r"(?iu)\b(?:approv\w+\s+the\s+design|design\s+of\s+the\s+(?:seal|flag)|official\s+seal\s+of|establish\w*\s+(?:an?\s+)?(?:official\s+)?(?:seal|flag)\b)\b",
    "symbol_title": r"(?iu)\b(?:seal|flag)\b",
    "public_commemoration": r"(?isu)\b(?:I\s+)?(?:call\s+upon|urge|invite|ask)\s+(?:all\s+)?(?:Americans?|the\s+(?:people|citizens)\s+of\s+the\s+United\s+States)\b.{0,300}?\b(?:observe|observance|commemorate|celebration|ceremonies|honor|pay\s+tribute)\b",
    "symbolic_honor": r"(?iu)\b(?:medals?|military\s+decorations?|service\s+decorations?|presidential\s+(?:service\s+)?(?:awards?|certificates?|badges?)|campaign\s+(?:medals?|ribbons?)|service\s+(?:medals?|ribbons?)|medal\s+of\s+(?:honor|freedom|valor)|national\s+security\s+medal)\b",
    "observance_designation": r"(?isu)\bdo\s+hereby\s+(?:proclaim|designate|request|urge|invite|ask|call\s+upon|affirm|set\s+aside)\b.{0,400}?\bas\s+(?:National\s+|the\s+)?[A-Z][\w\s,.'`\-]{1,100}?\b(?:Day|Week|Month|Year|Holiday)\b",
    "national_observance": r"(?iu)\bnational\s+days?\s+of\s+(?:prayer|remembrance|mourning|observance|service|thanksgiving|reconciliation|unity|honor|solidarity|healing)\b",
}


def ceremonial_reason(doc_type: Column, text: Column, title: Column, url: Column) -> Column:
    """The reason to leave a document out as ceremonial, else NULL. Vetoes come first."""
    p, t = CEREMONIAL, F.coalesce(text, F.lit(""))
    name = F.coalesce(F.nullif(title, F.lit("")), F.substring_index(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "/", -1))
    act = F.coalesce(doc_type == "proclamation", F.lit(False))
    return (
        F.when(t.rlike(p["veto"][0]) | t.rlike(p["veto"][1]), F.lit(None))
        .when(t.rlike(p["memorial_half_staff"]), "memorial_half_staff")
        .when(t.rlike(p["symbol_design"]) & (act | name.rlike(p["symbol_title"])), "symbol_design")
        .when(t.rlike(p["public_commemoration"]), "public_commemoration")
        .when(F.replace(name, F.lit("-"), F.lit(" ")).rlike(p["symbolic_honor"]), "symbolic_honor")
        .when(act & t.rlike(p["observance_designation"]), "observance_designation")
        .when(act & t.rlike(p["national_observance"]), "national_observance")
    )


def find_matches(text: Column, rules: list[tuple[str, str]]) -> Column:
    """array<struct<rule,text>> of all matches, rule after rule."""
    def named(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.lit(name).alias("rule"), m.alias("text")))

    each = [named(*rule) for rule in rules]
    return F.flatten(F.array(*each))


def clause_class(clauses: Column, generic: list[tuple[str, str]], specific: list[tuple[str, str]]) -> Column:
    """generic, specific or no_vesting_clause of a list of clauses; unmatched clauses count as specific."""
    joined = F.array_join(clauses, "\n")
    only = (F.size(find_matches(joined, generic)) > 0) & (F.size(find_matches(joined, specific)) == 0)
    return F.when(F.size(clauses) == 0, "no_vesting_clause").when(only, "generic").otherwise("specific")
