"""Claims against many tables of different schemas in one job."""

from ledgerlens.functions import vocab as V
from ledgerlens.operators import claims as CL
from ledgerlens.operators import many_tables as MT
from pyspark.sql import functions as F

SENTENCES = [
    "Revenue grew by 12% in Q2", "Net promoter score rose by 4 percent", "Our workforce shrank by 3%",
    "Turnover climbed 9%", "Total_revenue doubled", "The unit-price fell by 2%", "Unti price fell by 2%",
    "Churn rate fell", "Profits and earnings rose 5%", "arr rose 7%", "carry rose 7%", "Nothing of note", "", "q",
    "Revenu per head increased 3% in 2024", "Customers halved in FY2023", "Oppex went up 8%",
]
SCHEMAS = {
    "a": ["revenue", "unit_price", "headcount"],
    "b": ["total-revenue", "nps_score", "churn_rate_pct", "arr"],
    "c": ["Revenue Per Head", "sales", "opex", "customers", "profit"],
    "d": ["zzz"],
}


def _cells(spark, tables):
    rows = [(t, r, o, c, True, v, None if v is None else str(v))
            for t, cols in tables.items() for o, (c, vals) in enumerate(cols.items()) for r, v in enumerate(vals)]
    return spark.createDataFrame(rows, "table_id string, row_id int, ordinal int, column string, numeric boolean, "
                                       "value double, text string")


def test_rules_as_data_match_like_the_compiled_chain(spark):
    cells = _cells(spark, {t: {c: [1.0, 2.0] for c in cols} for t, cols in SCHEMAS.items()})
    claims = spark.createDataFrame([(t, i, s) for t in SCHEMAS for i, s in enumerate(SENTENCES)],
                                   "table_id string, claim_id long, claim string")
    got = {(r["table_id"], r["claim_id"]): tuple(r["m"]) for r in MT.match_claims(claims, cells).collect()}
    for t, cols in SCHEMAS.items():
        own = claims.filter(F.col("table_id") == t).select("claim_id", CL.match_column(F.col("claim"), cols).alias("m"))
        for r in own.collect():
            assert got[t, r["claim_id"]] == tuple(r["m"]), (t, SENTENCES[r["claim_id"]])
    assert len(got) == len(SCHEMAS) * len(SENTENCES)


def test_own_terms(spark):
    cells = _cells(spark, {"t": {"r_and_d": [1.0], "spend": [2.0]}})
    claims = spark.createDataFrame([("t", 1, "R&D rose 5%"), ("t", 2, "c++ rose 5%"), ("t", 3, "outlay rose 5%")],
                                   "table_id string, claim_id long, claim string")
    terms, aliases = {"r&d": ["r_and_d"], "outlay": ["spend"]}, {"spend": ["c++"]}
    got = {r["claim_id"]: (r["m"]["column"], r["m"]["method"])
           for r in MT.match_claims(claims, cells, terms, aliases).collect()}
    assert got == {1: ("r_and_d", "business-term"), 2: ("spend", "alias"), 3: ("spend", "business-term")}
    got = [r["m"]["column"] for r in MT.match_claims(claims.filter("claim_id = 3"), cells, {}, {}).collect()]
    assert got == [None]


def test_verdicts_equal_one_table_at_a_time(spark):
    wide = {
        "shop": spark.createDataFrame([(i, f"2023-q{i + 1}", 100.0 + 10 * i, float("nan") if i == 0 else 50.0 - i)
                                       for i in range(4)], "_row_id int, period string, revenue double, headcount double"),
        "zero": spark.createDataFrame([(0, 0.0, 1), (1, 5.0, 2)], "_row_id int, sales double, orders int"),
        "one": spark.createDataFrame([(0, 9.0)], "_row_id int, profit double"),
        "text": spark.createDataFrame([(0, "x")], "_row_id int, name string"),
    }
    texts = ["Revenue rose by 30%", "Revenue rose by 10% in Q2", "Revenue fell by 30% in 2023", "Headcount fell by 2%",
             "Sales doubled", "Orders doubled", "Profit rose by 4%", "Staff was content"]
    claims = spark.createDataFrame([(t, i, s) for t in [*wide, "unknown"] for i, s in enumerate(texts)],
                                   "table_id string, claim_id long, claim string")
    cells = None
    for t, df in wide.items():
        own = MT.table_cells(df, F.lit(t), "_row_id")
        cells = own if cells is None else cells.unionByName(own)
    got = {(r["table_id"], r["claim_id"]): tuple(r)[1:] for r in MT.verify_tables(claims, cells).collect()}
    for t, df in wide.items():
        for r in CL.verify(claims.filter(F.col("table_id") == t), df, "_row_id").collect():
            assert got[t, r["claim_id"]] == tuple(r), (t, r["claim"])
    reasons = {k: v[-1] for k, v in got.items()}
    assert "is 0" in reasons["zero", 4] and "fewer than 2" in reasons["one", 6]
    assert all(v[2] == "Unverifiable" and v[-1].startswith("No numeric") for k, v in got.items() if k[0] in ("text", "unknown"))
    assert len(got) == 5 * len(texts)


def test_hot_table_nulls_and_empty_inputs(spark):
    cells = _cells(spark, {"hot": {"revenue": [float(i + 1) for i in range(3000)]}, "nil": {"revenue": [None, None]}})
    claims = spark.createDataFrame([("hot", 1, "Revenue rose by 299900%"), ("nil", 2, "Revenue rose by 5%"),
                                    ("hot", 3, None), (None, 4, "Revenue rose by 5%")],
                                   "table_id string, claim_id long, claim string")
    got = {r["claim_id"]: (r["verdict"], r["csv_metric"]) for r in MT.verify_tables(claims, cells).collect()}
    assert got[1] == ("Supported", "revenue") and got[2] == ("Unverifiable", "revenue")
    assert got[3][0] == got[4][0] == "Unverifiable"
    assert MT.verify_tables(claims.filter("false"), cells).count() == 0
    assert MT.verify_tables(claims, cells.filter("false")).filter("verdict = 'Unverifiable'").count() == 4
    assert V.FUZZY_CUTOFF == 60


def test_registered_verdicts_reach_every_outcome(spark):
    from ledgerlens.plans.q_tables import q_verify_tables

    from .conftest import SF_SMALL

    rows = q_verify_tables(spark, SF_SMALL).collect()
    reasons = [r["reason"] for r in rows]
    for part in ("No CSV column", "No percentage value", "fewer than 2 non-null", "is 0; cannot", "Direction matches", "Claim says", "Filtered to"):
        assert any(part in r for r in reasons), part
    assert {r["match_method"].split("(")[0] for r in rows} == {"business-term", "exact", "alias", "fuzzy", "none"}
