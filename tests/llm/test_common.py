"""What tasks leave behind in the Python workers that ran them."""

from __future__ import annotations

import weakref

import pyarrow as pa
import pytest

from paceline.llm import common


class Held:
    pass


@pytest.mark.parametrize("whole", [True, False])
def test_memory_is_given_back_when_a_task_holds_nothing(monkeypatch, whole):
    seen, alive = [], []
    monkeypatch.setattr(common, "give_back", lambda: alive.append([x() is not None for x in seen]))

    def work(batches):
        held = Held()
        seen.append(weakref.ref(held))
        yield from batches

    batches = [pa.RecordBatch.from_arrays([pa.array([k])], ["k"]) for k in range(3)]
    rows = common.given_back(work)(iter(batches))
    if whole:
        assert list(rows) == batches
    else:  # a limit above reads no further
        assert next(rows) == batches[0]
        assert not alive
        rows.close()
    assert alive == [[False]]


def test_freed_arrow_memory_is_not_kept():
    """A hundred megabytes that Arrow frees leave the process with the task."""

    def held() -> int:
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * 4096 >> 20

    def work(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in batch["text"].to_pylist()])], ["n"])

    def texts():
        for k in range(16):
            yield pa.RecordBatch.from_arrays([pa.array([chr(97 + k) * 1000] * 8000)], ["text"])

    before = held()
    assert sum(batch.num_rows for batch in common.given_back(work)(texts())) == 16 * 8000
    assert held() - before < 40
