"""Encoding texts run by run: ids of runs seen before come from a bounded memo."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches ``begin``, ``size`` of ``flat``, one after the other."""
    total = np.cumsum(size)
    return flat[np.repeat(begin - (total - size), size) + np.arange(int(total[-1]) if len(size) else 0)]


class RunEncoder:
    """Base of tokenizers whose ids of a text are those of its runs, one after the other.

    A subclass writes a text as its runs with blanks between them (``prepare``) and knows
    the ids of runs (``ids_of``). Runs are cut, told apart and looked up in the memo by Arrow;
    Python sees only runs that are new. Beyond ``limit`` runs the memo keeps those that were
    met more than once since the last time.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self._keep(None)

    def _keep(self, some: np.ndarray | None) -> None:
        if some is None or some.sum() > self.limit // 2:
            self.keys = pa.array([], pa.string())
            self.flat = np.zeros(0, np.int32)
            self.begin, self.size, self.met = (np.zeros(0, np.int64) for _ in range(3))
        else:
            self.keys = self.keys.filter(pa.array(some))
            self.flat, self.size = _gather(self.flat, self.begin[some], self.size[some]), self.size[some]
            self.begin, self.met = np.cumsum(self.size) - self.size, np.zeros(len(self.size), np.int64)

    def prepare(self, text: str) -> str:
        raise NotImplementedError

    def ids_of(self, runs: list[str]) -> list[bytes]:
        """The ids of each run as 32-bit integers."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, number of ids per text)."""
        if len(self.keys) > self.limit:
            self._keep(self.met > 1)
        parts = pc.split_pattern(pa.array(list(map(self.prepare, texts)), pa.string()), " ")
        told = parts.flatten().dictionary_encode()
        runs = told.dictionary
        code = pc.index_in(runs, value_set=self.keys).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.nonzero(code < 0)[0]
        if len(new):
            unknown = runs.take(pa.array(new))
            ids = self.ids_of(unknown.to_pylist())
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            code[new] = np.arange(len(self.keys), len(self.keys) + len(new))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.int32)])
            self.size = np.concatenate([self.size, size])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
            self.keys = pa.concat_arrays([self.keys, unknown])
        self.met[code] += 1
        codes = code[told.indices.to_numpy()]
        n = self.size[codes]
        edges = np.concatenate([[0], np.cumsum(n)])[np.asarray(parts.offsets)]
        return _gather(self.flat, self.begin[codes], n), np.diff(edges)
