"""Encoding texts through a memo of their chunks, found and looked up by arrays."""

from __future__ import annotations

import numpy as np

from . import shingles


def _append(starts: np.ndarray, values: np.ndarray, count: int, more: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """starts and values with so many more runs of values after the first count ones; the arrays double as they fill."""
    at = int(starts[count])
    while at + len(more) > len(values):
        values = np.concatenate([values, np.zeros_like(values)])
    while count + len(sizes) + 1 > len(starts):
        starts = np.concatenate([starts, np.zeros_like(starts)])
    values[at : at + len(more)] = more
    starts[count + 1 : count + 1 + len(sizes)] = at + np.cumsum(sizes)
    return starts, values


def _runs(starts: np.ndarray, values: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values of some slots end to end, and where each begins."""
    begin = starts[slot]
    count = starts[slot + 1] - begin
    total = np.concatenate([[0], np.cumsum(count)])
    return values[np.arange(total[-1]) + np.repeat(begin - total[:-1], count)], total


class ChunkMemo:
    """Texts to ids. split() says which texts are plain and where chunks that encode alone start in them; the ids and
    bytes of chunks are kept by hash, up to most_chunks. A text is encoded whole where it isn't plain, or where a chunk's
    bytes aren't those kept under its hash, so no hash stands for a chunk unchecked."""

    def __init__(self, most_chunks: int = 500_000):
        self.most = most_chunks
        self._clear()

    def split(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        raise NotImplementedError

    def chunks(self, found: list[bytes]) -> list[np.ndarray]:
        raise NotImplementedError

    def _clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.begins = np.zeros(1 << 16, np.int64)
        self.chars = np.zeros(1 << 18, np.uint8)

    def _learn(self, hashes: list[int], found: list[bytes]) -> None:
        parts, count = self.chunks(found), len(self.slots)
        self.starts, self.ids = _append(self.starts, self.ids, count, np.concatenate(parts), [len(x) for x in parts])
        self.begins, self.chars = _append(self.begins, self.chars, count, np.frombuffer(b"".join(found), np.uint8), [len(x) for x in found])
        self.slots.update(zip(hashes, range(count, count + len(found))))

    def __call__(self, raw: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, from the UTF-8 bytes of all and their offsets."""
        if not len(raw):
            return self.whole([""] * (len(offs) - 1))
        plain, starts = self.split(raw, offs)
        if len(self.slots) > self.most:
            self._clear()
        data = raw.tobytes()
        whole = iter(self.whole([data[offs[k] : offs[k + 1]].decode() for k in np.flatnonzero(~plain)]))
        owner = np.searchsorted(offs, starts, side="right") - 1
        ends = np.minimum(np.append(starts[1:], len(raw)), offs[owner + 1])
        hashes, at, back = np.unique(shingles.spans(raw, starts, ends), return_index=True, return_inverse=True)
        hashes = hashes.tolist()
        slots = list(map(self.slots.get, hashes))
        if new := [k for k, s in enumerate(slots) if s is None]:
            self._learn([hashes[k] for k in new], [data[starts[at[k]] : ends[at[k]]] for k in new])
            for k in new:
                slots[k] = self.slots[hashes[k]]
        slot = np.array(slots, np.int64)[back]
        ids, total = _runs(self.starts, self.ids, slot)
        bounds = total[np.searchsorted(owner, np.arange(len(offs)))].tolist()
        out = [ids[bounds[k] : bounds[k + 1]] if p else next(whole) for k, p in enumerate(plain.tolist())]
        for k in self._strangers(raw, starts, ends, owner, slot):
            out[k] = self.whole([data[offs[k] : offs[k + 1]].decode()])[0]
        return out

    def _strangers(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray, slot: np.ndarray) -> list[int]:
        """Texts that hold a chunk whose bytes differ from those kept under its hash."""
        kept, total = _runs(self.begins, self.chars, slot)
        size = ends - starts
        odd = size != np.diff(total)
        if not odd.any():
            differ = raw[np.arange(total[-1]) + np.repeat(starts - total[:-1], size)] != kept
            if not differ.any():
                return []
            odd[np.searchsorted(total, np.flatnonzero(differ), side="right") - 1] = True
            return np.unique(owner[odd]).tolist()
        # Chunks of unequal length shift the rest, so the others are compared one by one.
        same = [not o and np.array_equal(raw[s:e], kept[t : t + e - s]) for o, s, e, t in zip(odd.tolist(), starts.tolist(), ends.tolist(), total.tolist())]
        return np.unique(owner[~np.array(same)]).tolist()
