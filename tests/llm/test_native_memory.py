"""What operators leave in the memory of executors and their Python workers."""

from sparkqa.llm import exact_dedup


def test_state_stores_go_with_rows(spark, tmp_path, monkeypatch):
    """Each opened store leaves native memory behind: a few rows open few, however many shuffle partitions there are."""
    monkeypatch.setattr(exact_dedup, "new_folder", lambda s, what: str(tmp_path / what))
    docs = spark.createDataFrame([(i, f"text {i % 40}") for i in range(100)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    before, cores = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", 3 * cores)
    try:
        rows = exact_dedup.dedup(spark.read.parquet(str(tmp_path / "docs"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r.doc_id for r in rows if r.kept} == set(range(60, 100)) and len(rows) == 100
    stores = [p.name for p in (tmp_path / "dedup" / "state" / "state" / "0").iterdir() if p.name.isdigit()]
    assert 0 < len(stores) <= cores
    monkeypatch.setattr(exact_dedup, "ROWS_A_STORE", 10)
    spark.conf.set("spark.sql.shuffle.partitions", 3 * cores)
    try:
        assert exact_dedup.stores_for(spark, 100) == min(3 * cores, max(cores, 10)) and exact_dedup.stores_for(spark, 10**6) == 3 * cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
