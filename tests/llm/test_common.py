import pyarrow as pa

from kadastra.llm import common


def test_memory_is_given_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    told = common.freed(lambda batches: batches)(iter([batch, batch]))
    assert next(told) is batch and not calls
    assert len(list(told)) == 1 and len(calls) == 1
    common.freed(lambda batches: batches)(iter([batch])).close()
