"""Token ids of the tokenizers library, with a bounded cache of what lies between single blanks.

Both tokenizers used here split a text before merging, so that no token spans a single space or newline between two characters
that are not blank, nor the place after a newline, nor that between a Latin letter and the punctuation that ends a word: ids of
the whole text are those of its pieces, one after another. Arrow finds the distinct pieces of many texts, parts them from their
punctuation and puts the ids together; pieces that are new, in lower case if the tokenizer ignores case, are encoded by the
library many at a time, as one text in which a control character that none of them has stands between them, and its id parts
them again. Texts with other blanks are cut by a pattern instead. A special token's string in a text is that token, as the library has it
unless told otherwise; texts that may hold one are given to the library whole. The cache lives as long as its Python worker.
"""

import re
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

CACHE, TOGETHER = 800_000, 100
#: Pieces of more characters, and more pieces that don't follow a blank than this, aren't kept.
LONGEST, OTHERS = 64, 100_000
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
MARK = "\x01"
TAIL = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
LETTER_LAST, LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]\\z", "\\A[\\x00-ÿ]*\\z"


def split(texts: pa.Array, lead: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(keys of all texts, how many each has). A key is a piece without its space, or with its newline; one is put before the first piece, unless a space leads."""
    rows = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    n = pc.list_value_length(rows).to_numpy().astype(np.int64)
    if lead:
        return rows.flatten(), n
    first = np.zeros(int(n.sum()), bool)
    first[np.cumsum(n) - n] = True
    keys = rows.flatten()
    lines = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), keys.filter(pa.array(first)), pa.scalar("", pa.large_string()))
    return pc.replace_with_mask(keys, pa.array(first), lines), n


def regular(key: str) -> bool:
    """Whether the key stands for a space or newline between characters that aren't blank, and can be kept."""
    word = key[1:] if key[:1] == "\n" else key
    return 0 < len(word) <= LONGEST and not word[0].isspace() and not word[-1].isspace() and MARK not in word


def lists(ids: np.ndarray, edge: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The lists ids[edge[i]:edge[i + 1]] of all i in use, one after another."""
    return pa.LargeListArray.from_arrays(pa.array(edge), pa.array(ids)).take(pa.array(use)).flatten().to_numpy()


def strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def edges(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


class Encoder:
    def __init__(self, path: str, plain: bool = False):
        """plain: the strings of special tokens are ordinary text."""
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        #: A part without letters, which no folding of case changes, of each special token's string.
        self.special = [] if plain else list({max(re.split(r"[^\W\d_]+", t.content), key=len) or t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.vocabulary = self.tokenizer.get_vocab()
        *self.lead, self.mark = self.ids(f" {MARK}").tolist()
        self.folds = np.array_equal(self.ids(" A"), self.ids(" a"))
        self.line = len(self.ids("\n"))
        #: Keys, numbered in order of their coming; key number i has the ids kept[edge[i]:edge[i + 1]].
        self.known: dict[str, int] = {}
        self.kept, self.edge = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.other: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def numbers(self, keys: list[str]) -> np.ndarray:
        """The numbers of distinct keys, -1 for those that aren't regular."""
        out = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = [i for i in np.flatnonzero(out < 0).tolist() if regular(keys[i])]
        if len(self.known) + len(new) > CACHE:  # what came first is the most frequent
            self.known = dict(islice(self.known.items(), CACHE // 2))
            self.edge = self.edge[: len(self.known) + 1]
            self.kept = self.kept[: self.edge[-1]]
            out[out >= len(self.known)] = -1
            new = [i for i in np.flatnonzero(out < 0).tolist() if regular(keys[i])]
        out[new] = len(self.known) + np.arange(len(new))
        self.learn([keys[i] for i in new])
        return out

    def learn(self, new: list[str]) -> None:
        extra = len(self.lead)
        kept, sizes = [self.kept], []
        for i in range(0, len(new), TOGETHER):
            part = new[i : i + TOGETHER]
            ids = self.ids("".join([f"{key} {MARK}" if key[0] == "\n" else f" {key} {MARK}" for key in part]))
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part):
                raise AssertionError("the mark was merged")
            own = np.ones(len(ids), bool)
            for back in range(extra + 1):
                own[ends - back] = False
            kept.append(ids[own])
            sizes.append(np.diff(ends, prepend=-1) - 1 - extra)
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.kept, self.edge = np.concatenate(kept), np.concatenate([self.edge, self.edge[-1] + np.cumsum(np.concatenate(sizes))])

    def table(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of distinct keys one after another, where each begins and the last ends, which are regular; others have no ids)."""
        core = pc.utf8_rtrim(keys, characters=TAIL)
        n = pc.utf8_length(core).to_numpy()
        at = np.flatnonzero(n < pc.utf8_length(keys).to_numpy())
        at = at[pc.match_substring_regex(core.take(pa.array(at)), LETTER_LAST).to_numpy(zero_copy_only=False)]
        tails = [k[i:] for k, i in zip(strings(keys.take(pa.array(at))), n[at].tolist(), strict=True)]
        tailed = np.zeros(len(keys), bool)
        tailed[at] = True
        core = pc.if_else(pa.array(tailed), core, keys)
        if self.folds:
            core = pc.if_else(pc.match_substring_regex(core, LATIN), pc.utf8_lower(core), core)
        coded = core.dictionary_encode()
        number = self.numbers(strings(coded.dictionary))[coded.indices.to_numpy()]

        # the lists that are known, those of the tails, and an empty one
        ends = list(dict.fromkeys(tails))
        raw = [*map(self.piece, ends), b""]
        size = np.concatenate([np.diff(self.edge), [len(x) // 4 for x in raw]])
        none, place = len(size) - 1, dict(zip(ends, range(len(self.known), len(size)), strict=False))
        use = np.full((len(keys), 2), none)
        ok = number >= 0
        use[ok, 0] = number[ok]
        use[at, 1] = [place[t] for t in tails]
        use[~ok, 1] = none
        edge = edges(size)
        return lists(np.concatenate([self.kept, np.frombuffer(b"".join(raw), "<u4")]), edge, use.reshape(-1)), edges(size[use].sum(axis=1)), ok

    def piece(self, piece: str) -> bytes:
        """Ids of a whole piece, from the library."""
        found = self.other.get(piece)
        if found is None:
            found = self.ids(piece).tobytes() if piece else b""
            if len(piece) <= LONGEST and len(self.other) < OTHERS:
                self.other[piece] = found
        return found

    def may_hold_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts with other blanks, or with what isn't kept, piece by piece; of texts that may hold a special token, at once."""
        cut = [[t] if self.may_hold_special(t) else CUT.split(t) for t in texts]
        keys = list({p[1:] if p[0] == " " else p for pieces in cut for p in pieces[1:]})
        ids, edge, ok = self.table(pa.array(keys, pa.large_string()))
        data, edge = ids.tobytes(), (4 * edge).tolist()
        found = {k: data[edge[i] : edge[i + 1]] for i, (k, good) in enumerate(zip(keys, ok.tolist(), strict=True)) if good}
        out = []
        for first, *rest in cut:
            own = [self.piece(first)]
            for p in rest:
                x = found.get(p[1:] if p[0] == " " else p)
                own.append(self.piece(p) if x is None else x)
            out.append(b"".join(own))
        return out

    def flat(self, texts: pa.Array, end: int | None = None, lead: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids of each text); a null or empty text has none. After each text stands the end id, if any; with lead, a space is put before each."""
        out = self.joined(texts, end, lead)
        pa.default_memory_pool().release_unused()  # the worker may serve other operators next
        return out

    def joined(self, texts: pa.Array, end: int | None, lead: bool) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        keys, n = split(texts, lead)
        coded = keys.dictionary_encode()
        ids, edge, ok = self.table(coded.dictionary)
        of = coded.indices.to_numpy()
        odd = np.logical_or.reduceat(~ok[of], np.cumsum(n) - n)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        other = np.flatnonzero(odd)
        given = strings(texts.take(pa.array(other)))
        raw = [*self.whole([f" {t}" if t else t for t in given] if lead else given), *([] if end is None else [np.array([end], "<u4").tobytes()])]
        size = np.concatenate([np.diff(edge), np.array([len(p) // 4 for p in raw], np.int64)])

        # a text's place in the result: its keys, or what whole() gave, then the end
        m = np.where(odd, 1, n) + (end is not None)
        last = np.cumsum(m)
        use, own = np.empty(last[-1], np.int64), np.ones(last[-1], bool)
        if end is not None:
            use[last - 1], own[last - 1] = len(size) - 1, False
        use[(last - m)[other]], own[(last - m)[other]] = len(ok) + np.arange(len(other)), False
        use[own] = of[~np.repeat(odd, n)]
        out, counts = lists(np.concatenate([ids, np.frombuffer(b"".join(raw), "<u4")]), edges(size), use), np.add.reduceat(size[use], last - m)
        if self.line and not lead:  # the newline before a text
            keep = np.ones(len(out), bool)
            begin = (np.cumsum(counts) - counts)[~odd]
            for i in range(self.line):
                keep[begin + i] = False
            out, counts = out[keep], counts - np.where(odd, 0, self.line)
        return out, counts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, counts = self.flat(pa.array(texts, pa.large_string()))
        edge, data = (4 * edges(counts)).tolist(), ids.tobytes()
        return [data[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
