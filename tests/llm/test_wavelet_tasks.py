"""What the wavelet shards of a small table that is dealt over many tasks cost: files of Spark's writers and reading tasks."""

import pytest

from terrane.llm import wavelet
from terrane.llm.tokens import vocabulary


@pytest.fixture
def dealt(spark):
    """64 documents in 16 tasks, as where small partitions are not merged."""
    new = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark.createDataFrame([(i, "word " * (i + 1)) for i in range(64)], "doc_id long, text string")
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_task_writes_the_table_of_shards(dealt):
    """Every task wrote a part of it, and for each file and folder of a part an executor started a process."""
    shards = wavelet.write_token_shards(dealt, vocabulary("word_bpe_49k.json"))
    assert len(shards.inputFiles()) == 1
    rows = sorted(shards.collect(), key=lambda r: r.shard)
    assert len(rows) == 16 and [r.shard for r in rows] == list(range(16)) and len({r.path for r in rows}) == 16
    assert [r.first_token for r in rows] == [sum(r.n_tokens for r in rows[:k]) for k in range(16)]
    assert sum(r.n_docs for r in rows) == 64 and sum(r.n_tokens for r in rows) == sum(i + 2 for i in range(64))


def test_readers_are_as_many_as_the_ids_need(dealt, monkeypatch):
    """Sixteen shards of some ids had sixteen reading tasks, each with an output of its own."""
    shards = wavelet.write_token_shards(dealt, vocabulary("word_bpe_49k.json"))
    total = sum(i + 2 for i in range(64))
    for least, tasks in ((1 << 20, 1), (total, 1), (total - 1, 2), (total // 5, 6), (1, 16)):
        monkeypatch.setattr(wavelet, "_READ", least, raising=False)
        got = wavelet.read_token_shards(shards)
        assert got.rdd.getNumPartitions() == tasks
        assert sorted((r.doc_id, r.start, r.n_tokens) for r in got.collect()) == [(i, sum(k + 2 for k in range(i)), i + 2) for i in range(64)]
