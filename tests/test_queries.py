"""Each registered query that has SQL against DuckDB; the inline texts cover the scripts that the tables lack."""

import duckdb
import pytest

from scriptora.plans.catalogue import ORACLE_SQL, QUERIES

QUICK = ["clean_text", "nfc_clean", "lower_latin", "char_class_counts", "dominant_script", "heuristic_indic", "devanagari_disambiguation", "stratified_split", "overall_metrics", "lang_hints", "char_script_names", "char_in_script", "similarity_matrix", "full_report", "confidence_histogram", "vote_top_five", "identified_texts", "model_vote", "stream_profile"]


def plain(frame, columns):
    return sorted(tuple("" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in row) for row in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, sf, name):
    base = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations"):
        base.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    found, want = QUERIES[name](spark, sf).toPandas(), base.sql(ORACLE_SQL[name]).df()
    assert sorted(found.columns) == sorted(want.columns)
    assert plain(found, sorted(found.columns)) == plain(want, sorted(found.columns))
