"""The prefix tables of many pieces at once: valid last tokens by vector operations.

Three tables of a vocabulary, built once on the driver and bounded by its size:

* a trie over the tokens' bytes, as a map (state, byte) -> state;
* how each token was made: the two tokens of its last merge;
* which two tokens, written one behind the other, are a token's bytes.

Two neighbouring tokens are *compatible* when no merge across their border comes
before the merges that made them.  Going back in time, the later one of the two
tokens at the border is taken apart, until both are bytes or a merge across the
border that is early enough is met.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Pieces of up to so many bytes are worked on in matrices of these widths; longer ones alone.
WIDTHS = (4, 8, 16, 32)
#: Pieces of one matrix.
ROWS = 1 << 15


class NumberMap:
    """A read-only map of 64-bit keys to 32-bit numbers, -1 for others (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << bits, -1, np.int32)
        keys, values = keys.astype(np.uint64), values.astype(np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.values[at], -1)
        open_ = np.nonzero((held != keys) & (held != np.uint64(2**64 - 1)))[0]
        while len(open_):
            at = (at + 1) & self.mask if len(at) == len(open_) else (at[open_] + 1) & self.mask
            keys = keys if len(keys) == len(open_) else keys[open_]
            held = self.keys[at]
            hit = held == keys
            found[open_[hit]] = self.values[at[hit]]
            more = ~hit & (held != np.uint64(2**64 - 1))
            open_, at, keys = open_[more], at[more], keys[more]
        return found


class PrefixTables:
    """Tables of one vocabulary (ranks of byte strings; every single byte is a token)."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.size = np.zeros(size, np.int32)
        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.sound = np.zeros(size, bool)
        pair_keys, pair_values = [], []
        state_of, step_keys, states = {b"": 0}, [], []
        token_of = [-1]
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.size[rank] = len(token)
            made = _last_merge(token, rank, ranks)
            if made is not None:
                self.left[rank], self.right[rank] = made
                self.sound[rank] = True
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pair_keys.append(a << 32 | b)
                    pair_values.append(rank)
            state = 0
            for end in range(1, len(token) + 1):
                part = token[:end]
                following = state_of.get(part)
                if following is None:
                    following = state_of[part] = len(token_of)
                    token_of.append(-1)
                    step_keys.append(state << 8 | token[end - 1])
                    states.append(following)
                state = following
            token_of[state] = rank
        self.token_of = np.array(token_of, np.int32)
        self.step = NumberMap(np.array(step_keys, np.uint64), np.array(states, np.int64))
        self.pair = NumberMap(np.array(pair_keys, np.uint64), np.array(pair_values, np.int64))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens ``a`` and ``b``, side by side, are the encoding of their bytes."""
        out = np.zeros(len(a), bool)
        at = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        before = np.full(len(a), 1 << 40)  # a merge of a lower rank than this comes first
        while len(at):
            across = self.pair((a << 32 | b).astype(np.uint64))
            apart = (across < 0) | (across >= before)
            at, a, b = at[apart], a[apart], b[apart]
            whole_a, whole_b = self.left[a] < 0, self.left[b] < 0
            done = whole_a & whole_b
            out[at[done]] = True
            keep = ~done
            at, a, b, whole_a, whole_b = at[keep], a[keep], b[keep], whole_a[keep], whole_b[keep]
            # the later one is taken apart; of equal ranks the left one was made first
            first = ~whole_a & (whole_b | (a > b))
            before = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def last_tokens(self, text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of bytes: the valid last token of each prefix (by its end), and the token that is the whole row or -1."""
        rows, width = text.shape
        last = np.full((rows, width + 1), -1, np.int32)
        whole = np.full(rows, -1, np.int32)
        found: list[list] = [[] for _ in range(width + 1)]
        for start in range(width):
            own = np.nonzero(sizes > start)[0]
            state = np.zeros(len(own), np.int64)
            for end in range(start + 1, width + 1):
                state = self.step((state << 8 | text[own, end - 1]).astype(np.uint64)).astype(np.int64)
                alive = (state >= 0) & (sizes[own] >= end)
                own, state = own[alive], state[alive]
                if not len(own):
                    break
                token = self.token_of[state]
                hit = token >= 0
                if hit.any():
                    found[end].append((start, own[hit], token[hit]))
                if start == 0:
                    full = hit & (sizes[own] == end)
                    whole[own[full]] = token[full]
        for end in range(1, width + 1):
            for start, own, token in found[end]:  # longest tokens first
                open_ = last[own, end] < 0
                own, token = own[open_], token[open_]
                good = self.sound[token] if start == 0 else self.compatible(last[own, start], token)
                last[own[good], end] = token[good]
            found[end] = []
        return last, whole

    def encode(self, pieces: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, ids, counts): tokens of the pieces of up to ``WIDTHS[-1]`` bytes, laid end to end in ``order``."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order, ids, counts, below = [], [], [], 0
        for width in WIDTHS:
            chosen = np.nonzero((sizes > below) & (sizes <= width))[0]
            below = width
            for k in range(0, len(chosen), ROWS):
                own = chosen[k : k + ROWS]
                text = np.frombuffer(b"".join([pieces[i].ljust(width, b"\0") for i in own.tolist()]), np.uint8).reshape(len(own), width)
                some, many = self._walk(*self.last_tokens(text, sizes[own]), sizes[own])
                order += own.tolist()
                ids.append(some)
                counts.append(many)
        if not order:
            return [], np.empty(0, np.int32), np.empty(0, np.int64)
        return order, np.concatenate(ids), np.concatenate(counts)

    def _walk(self, last: np.ndarray, whole: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each row, walked from its end; (ids end to end, counts)."""
        rows = np.nonzero(whole < 0)[0]
        end = sizes[rows]
        owner, token, place = [np.nonzero(whole >= 0)[0]], [whole[whole >= 0]], [np.zeros(int((whole >= 0).sum()), np.int64)]
        step = 0
        while len(rows):
            t = last[rows, end]
            owner.append(rows)
            token.append(t)
            place.append(np.full(len(rows), -step))
            end = end - self.size[t]
            left = end > 0
            rows, end, step = rows[left], end[left], step + 1
        owner, token, place = np.concatenate(owner), np.concatenate(token), np.concatenate(place)
        return token[np.lexsort((place, owner))], np.bincount(owner, minlength=len(sizes))


def _last_merge(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens of a token's last merge; (-1, -1) for a byte, None if merging its bytes doesn't give it."""
    if len(token) == 1:
        return -1, -1
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = rank, -1
        for i in range(len(parts) - 1):
            found = ranks.get(parts[i] + parts[i + 1])
            if found is not None and found < best:
                best, at = found, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return ranks[parts[0]], ranks[parts[1]]
