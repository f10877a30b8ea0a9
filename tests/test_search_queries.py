import pytest

from lakevec.plans import vector_queries as v


@pytest.mark.parametrize("name", ["search_memory", "search_beam", "search_page", "search_rerank", "update_cycle"])
def test_every_fiftieth_row_is_searched_for(name, spark, monkeypatch):
    monkeypatch.setattr(v.graph, "search", lambda queries, *a, **k: queries)
    monkeypatch.setattr(v.graph, "build", lambda base, *a: (base, base))
    monkeypatch.setattr(v.update, "insert", lambda new, old, t, e, **k: (t, old))
    monkeypatch.setattr(v.update, "consolidate", lambda t, x, e, dead: (t, x, e))
    monkeypatch.setattr(v, "coder_of", lambda base: None)
    monkeypatch.setattr(v.layout, "pages", lambda *a: None)
    got = v.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(r["qid"] for r in got.select("qid").collect()) == list(range(0, 500, 50))
