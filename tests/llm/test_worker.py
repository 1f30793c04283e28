"""What a Python worker keeps between tasks."""

from weftline.llm import _worker


def test_one_kernels_tables_are_kept():
    made = []

    def make(name):
        return lambda: made.append(name) or [name]

    first = _worker.kept("a", make("a"))
    assert _worker.kept("a", make("a")) is first and made == ["a"]
    assert _worker.kept("b", make("b")) == ["b"] and made == ["a", "b"]
    assert _worker.kept("a", make("a")) is not first and made == ["a", "b", "a"]
    _worker.release()
    assert not _worker._kept
    _worker.release()
