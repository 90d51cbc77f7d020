"""The discovery queries ask for whole fits."""

from __future__ import annotations

import inspect

from clipmotif.catalog import discovery
from clipmotif.operators import em
from clipmotif.plans import programs


def test_queries_fit_as_far_as_the_program(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "acgtacgtgcatctga" * 3) for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = []

    def seen(f, out):
        def call(*args, **named):
            bound = inspect.signature(f).bind(*args, **named)
            bound.apply_defaults()
            asked.append(bound.arguments)
            return out

        return call

    monkeypatch.setattr(programs, "discover_motifs", seen(programs.discover_motifs, []))
    monkeypatch.setattr(em, "fit", seen(em.fit, [em.replace(discovery.MODEL, ll=0.0)]))
    assert discovery.discover_motifs(spark, str(tmp_path)).count() == 0
    assert discovery.em_rounds(spark, str(tmp_path)).count() > 0
    assert [asked[0][k] for k in ("motifs", "starts", "rounds")] == [10, 10, 10]
    assert asked[1]["rounds"] == em.MAX_ROUNDS == 10
