"""What a Python worker keeps while it goes through texts, and how it gives it back."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


#: What the worker holds from task to task, by owner.
_HELD: dict[str, object] = {}


def held(owner: str, make: Callable[[], object]) -> object:
    """What a worker makes once and uses in all tasks of one operator, such as a loaded vocabulary."""
    if owner not in _HELD:
        _HELD[owner] = make()
    return _HELD[owner]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function over batches that hands memory back.

    A worker lives on for the tasks of later stages. What another operator held goes when
    the task begins, and what this task's own caches and batches took when it ends.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if others := [name for name in _HELD if name != owner]:
            for name in others:
                del _HELD[name]
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Return freed memory to the system, as far as the libraries can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


class Recent:
    """Two generations of words: when the young one is full it becomes the old one.

    Words that come again move to the young one, so frequent words stay and memory is
    bounded by twice the limit. ``make`` gives the value of a word, never None; longer
    words than ``longest`` are not kept.
    """

    def __init__(self, make: Callable[[str], object], limit: int, longest: int = 64):
        self.make, self.limit, self.longest = make, limit, longest
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def put(self, word: str, value: object) -> object:
        if len(word) <= self.longest:
            if len(self.young) >= self.limit:
                self.old, self.young = self.young, {}
            self.young[word] = value
        return value

    def one(self, word: str) -> object:
        if (value := self.young.get(word)) is not None:
            return value
        if (value := self.old.get(word)) is None:
            value = self.make(word)
        return self.put(word, value)

    def all(self, words: list[str]) -> list:
        found = list(map(self.young.get, words))
        if None in found:
            one = self.one
            found = [one(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return found
