"""The ingestion chain: run twice, killed in the middle, and with pages that change."""

import pytest
from pyspark.sql import functions as F

from quillstone.sources import landing
from quillstone.streaming import ingestion

PAGE = "<html><title>Filing {0}</title><h2>Item 1A. Risk Factors</h2><p>Supply of part {0} may be short this year.</p><table><tr><td>Part</td><td>Count</td></tr><tr><td>{0}</td><td>7</td></tr></table><p>{1}</p></html>"


def pages(numbers, tail="The end."):
    return [(f"page-{i}", PAGE.format(i, tail).encode()) for i in numbers]


def embed(chunks):
    return chunks.select("chunk_id", F.array(F.length("chunk_text").cast("double")).alias("vector"))


def state(spark, root):
    out = {}
    for name, columns in (("elements", ["document", "reading_order", "element_type", "text"]), ("chunks", ["chunk_id", "chunk_type", "chunk_text"]), ("vectors", ["chunk_id", "vector"])):
        out[name] = sorted(map(str, spark.read.parquet(f"{root}/{name}").select(*columns).collect()))
    return out


def test_chain_runs_twice_and_survives_a_stop(spark, tmp_path):
    whole, broken, land = (str(tmp_path / x) for x in ("whole", "broken", "landing"))
    ingestion.ingest(spark, land, whole, embed)  # nothing has landed
    landing.land(land, [*pages(range(6)), ("copy", pages([0])[0][1])])
    ingestion.ingest(spark, land, whole, embed)
    first = state(spark, whole)
    assert len(first["elements"]) == 6 * 5 and len(first["chunks"]) == len(first["vectors"]) == 6 * 6
    ingestion.ingest(spark, land, whole, embed)
    assert state(spark, whole) == first
    landing.land(land, [*pages([0, 1]), *pages([2], "Changed."), *pages([7])])
    ingestion.ingest(spark, land, whole, embed)
    last = state(spark, whole)
    assert len(last["elements"]) == 6 * 5 + 2 * 5 and set(first["chunks"]) < set(last["chunks"])

    def fails(chunks):
        raise RuntimeError("the provider is away")

    for failing in (fails, fails):
        with pytest.raises(Exception):
            ingestion.ingest(spark, land, broken, failing, files=1)
    # A batch that wrote its folder but didn't commit: it is run again and writes the same.
    spark.read.parquet(f"{broken}/chunks").drop("batch").limit(3).transform(embed).write.parquet(f"{broken}/vectors/batch=0")
    ingestion.ingest(spark, land, broken, embed, files=1)
    assert state(spark, broken) == last
