"""Every query of the catalogue against its SQL, on the smallest tables."""

import pytest
import verify

from attestry.plans import catalog, catalog_more, catalog_more_sql, catalog_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog_sql.ORACLE_SQL | catalog_more_sql.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert verify.compare(spark, name, SF).startswith(f"{name}: equal")


def test_queries_without_sql_are_few():
    assert set(catalog.QUERIES) - set(catalog_sql.ORACLE_SQL) == {"chunks"}
    assert set(catalog_more.QUERIES) == set(catalog_more_sql.ORACLE_SQL)


def test_chunks_cover_their_text(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {}
    for r in catalog.chunks(spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.n, r.chunk))
    assert got.keys() == texts.keys()
    for i, parts in got.items():
        parts = [c for _, c in sorted(parts)]
        assert all(len(c) <= 1600 for c in parts)
        at = 0
        for c in parts:  # each chunk begins at or before the end of what came before, and none of the text is left out
            start = texts[i].find(c, max(0, at - 400))
            assert 0 <= start <= at
            at = max(at, start + len(c))
        assert at == len(texts[i])


def test_brief_names_every_claim_with_its_verdict(spark):
    body = catalog.brief_body(spark, SF).first().body
    assert "(confirmed by 2 independent sources). [S0][S1]" in body
    assert "CONFLICTING REPORTS — asserted by city_desk; denied by rail_board" in body
