"""Token ids of whole texts from a worker's cache of runs between white space.

For a vocabulary whose split drops white space, the ids of a text are those of its runs one after the other. Runs that the cache lacks
are encoded together in one call, parted by a special token. Where the vocabulary lowers letters, A-Z are lowered before the lookup,
except in texts with combining marks, which compose with some small letters alone.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from .common import held
from .tokencount import specials, tokenizer

#: Runs and bytes that one generation of the cache holds; two are kept.
RUNS, BYTES = 300_000, 6_000_000
#: Runs in one string for the library; short strings cost it less a run than long ones.
TOGETHER = 64
#: The first bytes of U+0300 to U+037F in UTF-8.
_MARKS = (b"\xcc", b"\xcd")


class ChunkIds:
    def __init__(self, path: str):
        self.encoder, self.special = tokenizer(path), [s.lower().encode() for s in specials(path)]
        self.mark = specials(path)[0] if self.special else None
        self.mark_id = self.encoder.token_to_id(self.mark) if self.mark else None
        self.lowers = self._ids("ABC xyz") == self._ids("abc xyz")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.bytes = 0

    def _ids(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encoded(self, runs: list[bytes]) -> list[bytes]:
        texts = [run.decode("utf-8", "surrogatepass") for run in runs]
        if self.mark is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = []
        joined = [self.mark.join(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER)]
        for found in self.encoder.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(found.ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            raw, at = ids.tobytes(), 0
            for end in ends:
                out.append(raw[4 * at : 4 * end])
                at = end + 1
        return out

    def _runs(self, text: bytes) -> list[bytes] | None:
        """None if the text has a special string: the library reads it whole."""
        low = text.lower()
        if any(s in low for s in self.special):
            return None
        return (low if self.lowers and not any(m in text for m in _MARKS) else text).split()

    def of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text (UTF-8), as little-endian unsigned 32-bit numbers."""
        if len(self.young) > RUNS or self.bytes > BYTES:
            self.old, self.young, self.bytes = self.young, {}, 0
        split = [self._runs(t) for t in texts]
        # Each distinct run of these texts is looked up once; the texts then read a small table.
        found = dict.fromkeys(chain.from_iterable(x for x in split if x is not None))
        young, old, fresh = self.young, self.old, []
        for run in found:
            if (ids := young.get(run)) is None:
                if (ids := old.get(run)) is None:
                    fresh.append(run)
                    continue
                young[run] = ids
            found[run] = ids
        encoded = dict(zip(fresh, self._encoded(fresh), strict=True)) if fresh else {}
        found.update(encoded)
        young.update(encoded)
        self.bytes += sum(map(len, fresh))
        get = found.__getitem__
        return [self._ids(t.decode("utf-8", "surrogatepass")) if runs is None else b"".join(map(get, runs)) for t, runs in zip(texts, split, strict=True)]


def chunk_ids(path: str) -> ChunkIds:
    """A worker's own: it serves the tasks of that worker one after the other, so its cache stays warm between them."""
    return held("runs", path, lambda: ChunkIds(path))
