"""Rule tables: priority, wildcards, party names and alliances with the reference cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import rules


def test_first_fitting_rule_wins(spark):
    table = rules.table(spark, "s string, y int, label string", [("A", 1, "both"), (None, 2, "year"), ("A", None, "state"), ("A", 2, "late"), (None, None, "any")])
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 2), ("B", 1), (None, 2), (None, None), ("A", 1)], "s string, y int")
    got = sorted((str(r.s), str(r.y), r.label) for r in rules.first_match(rows, table, ["s", "y"], "label").collect())
    assert got == [("A", "1", "both"), ("A", "1", "both"), ("A", "2", "year"), ("A", "3", "state"), ("B", "1", "any"), ("B", "2", "year"), ("None", "2", "year"), ("None", "None", "any")]
    some = rules.first_match(rows, table.where("priority = 0"), ["s", "y"], "label").where("label is null")
    assert some.count() == 6
    none = rules.first_match(rows, table.limit(0), ["s", "y"], "label")
    assert none.count() == 8 and none.where("label is not null").count() == 0
    assert rules.first_match(rows.limit(0), table, ["s", "y"], "label").count() == 0


ALIASES = [("name", None, "indian national congress", "INC"), ("name", None, "bharat rashtra samithi", "BRS"), ("name", None, "bharatiya janata party", "BJP"), ("name", None, "nationalist congress party sharadchandra pawar", "NCP(SP)"), ("name", None, "independents", "IND"), ("code", None, "TRS", "BRS"), ("code", None, "CPI(M)", "CPM"), ("code", None, "ADMK", "AIADMK"), ("extra", None, "nota", "NOTA"), ("extra", None, "jan suraaj party", "JSP"), ("epoch", 2004, "JDU", "JD(U)")]


def test_party_names_of_all_sources(spark):
    names = {"Independents[29]": "IND", " Indian  National Congress ": "INC", "Nationalist Congress Party\x96Sharadchandra Pawar": "NCP(SP)", "Nationalist Congress Party – Sharadchandra Pawar": "NCP(SP)", "TRS": "BRS", "CPI(M)": "CPM", "People\x92s": "People's", "Jan Suraaj Party": "JSP", "JDU": "JDU", "": "", "nota": "NOTA"}
    rows = spark.createDataFrame([(n, 2020) for n in names] + [(None, 2020), ("JDU", 2004)], "p string, y int")
    aliases = spark.createDataFrame(ALIASES, "step string, epoch int, key string, code string")
    got = {(r.p, r.y): r.code for r in rules.standard_parties(rows, "p", aliases, "y").collect()}
    assert got == {(n, 2020): c for n, c in names.items()} | {(None, 2020): None, ("JDU", 2004): "JD(U)"}


def test_alliances_in_order(spark):
    table = rules.alliance_rules(spark, [("Andhra Pradesh", 2024, "JSP", "BJP Alliance (NDA)"), ("Telangana", 2023, "CPI", "INC Alliance (INC-CPI)")], [("kutami", "BJP Alliance (NDA)")])
    cases = [
        ("Andhra Pradesh", 2024, "JSP", "INC", "BJP Alliance (NDA)"), ("X", 2024, "TDP", " Kutami", "BJP Alliance (NDA)"), ("X", 2024, "BJP", None, "BJP Alliance (BJP)"), ("X", 2024, "BJP", "BJP Alliance (Mahayuti)", "BJP Alliance (Mahayuti)"),
        ("X", 2024, "SHS", "Bharatiya Janata Party", "BJP Alliance (BJP)"), ("X", 2024, "INC", "Unaligned", "INC Alliance (INC)"), ("X", 2024, "CPM", "INC", "INC Alliance (INC)"), ("X", 2024, "IND", "BSP", "Independent/Unaligned"),
        ("X", 2024, "BSP", "Independents[3]", "Independent/Unaligned"), ("X", 2024, "BRS", "TRS", "Unaligned"), ("X", 2024, "CPM", "LDF", "LDF"), ("X", 2024, "CPM", "  ", None), ("X", 2024, None, "LDF", "LDF"), ("X", 2024, "BJP", "INC", "BJP Alliance (BJP)"),
    ]
    aliases = spark.createDataFrame(ALIASES, "step string, epoch int, key string, code string")
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, y int, party string, a string, want string")
    got = {r.i: r.label for r in rules.standard_alliances(rows, table, aliases).collect()}
    assert got == {i: c[-1] for i, c in enumerate(cases)}


def test_what_is_no_party(spark):
    names = ["INC", "Others", "TOTAL", "Invalid/blank votes", "Valid Votes[2]", "None of the Above", "NOTA", "", "Registered voters", "Total Party", "Other parties and independents", "Turnout"]
    rows = spark.createDataFrame([(n,) for n in names] + [(None,)], "p string")
    assert [r.p for r in rows.where(~rules.junk(F.col("p"))).collect()] == ["INC", "Total Party"]
