"""The evidence batch over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.plans import evidence as plan
from assayer.queries import corpus, findings

SF = "/root/testdata/sf0.001"


def test_the_batch_extracts_once(spark, monkeypatch):
    calls = []
    real = plan.assemble_extraction

    def counted(*args, **kw):
        calls.append(1)
        return real(*args, **kw)

    def stored(*_):
        raise AssertionError("a second extraction")

    monkeypatch.setattr(plan, "assemble_extraction", counted)
    monkeypatch.setattr(corpus, "evidence", stored)
    out = findings.batch.__wrapped__(spark, SF)
    assert len(calls) == 1
    assert out.metrics.agg(F.count("*")).first()[0] > 0
