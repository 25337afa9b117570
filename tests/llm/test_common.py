"""Helpers of the text operators."""

import pyarrow as pa
import pytest

from flowsight.llm.common import frugal, text_chunks


def test_a_frugal_task_gives_what_the_task_gives():
    ended = []

    @frugal
    def run(batches, factor, extra=0):
        """A task."""
        for batch in batches:
            yield [x * factor + extra for x in batch]
        ended.append(True)

    assert list(run(iter([[1, 2], [3]]), 2, extra=1)) == [[3, 5], [7]] and ended
    assert run.__doc__ == "A task."
    assert list(run(iter([]), 1)) == []

    @frugal
    def broken(batches):
        yield from batches
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        list(broken(iter([1])))


def test_chunks_take_a_long_text_alone():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 50, "", "d" * 9, "e"])], names=["text"])
    parts = [texts for _, texts in text_chunks(batch, limit=10)]
    assert parts == [["ab", ""], ["c" * 50], ["", "d" * 9, "e"]]
