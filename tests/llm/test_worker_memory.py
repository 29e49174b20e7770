"""Workers give back what a task needed, before the next one starts."""

from __future__ import annotations

import pyarrow as pa

from quern.llm import near_minhash, text_bytes


def test_tasks_give_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(text_bytes, "give_back", lambda: given.append(1))
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["a b c d e f", None])], ["id", "text"])
    assert [b.column(1).to_pylist() for b in near_minhash._sketches(iter([batch]))] == [[2, 0]] and given == [1]
    for task in (near_minhash._sets, near_minhash._verified(80)):
        assert list(task(iter([]))) == []
    assert given == [1, 1, 1]
