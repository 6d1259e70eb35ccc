"""ids of texts by the tokenizers library, which sees each pre-token once.

A group of texts is one byte buffer. Its pre-tokens are found by comparing
neighbouring characters' classes in whole arrays, without a pattern matcher;
Arrow numbers the different ones; those not met before go to the library's
byte-pair model, strung together, and the ids of all occurrences are gathered
from one table. Texts that these rules do not cover (letters beyond
``PLAIN_END``, special strings) go to the library as they are.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from churnkit.llm import common as C
from churnkit.llm.token_counts import byte_letters

#: Letters up to here have one class in every Unicode version.
PLAIN_END = 0x500
WHITE, LETTER, NUMBER, OTHER, FOREIGN = range(5)
ID = np.dtype("<u4")
TOGETHER = 2000                       # pre-tokens strung together for the library
KEEP_BYTES = 48                       # longer pre-tokens are not kept
KEPT_COST = 160                       # memory of a kept pre-token besides its bytes and ids
# The contractions and the white space of the published split pattern of this tokenizer family.
CONTRACTIONS = (b"'s", b"'t", b"'re", b"'ve", b"'m", b"'ll", b"'d")
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0"


def _classes() -> np.ndarray:
    """The class of each code point below PLAIN_END."""
    kinds = {"L": LETTER, "N": NUMBER}
    return np.array([WHITE if c in WHITE_SPACE else kinds.get(unicodedata.category(c)[0], OTHER)
                     for c in map(chr, range(PLAIN_END))], np.uint8)


class Pretokens:
    """Starts of pre-tokens in a buffer of texts."""

    def __init__(self):
        self.classes = _classes()
        ascii_class = np.full(256, FOREIGN, np.uint8)
        ascii_class[:128] = self.classes[:128]
        self.of_byte = ascii_class

    def kinds(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character. A character beyond the table gives FOREIGN."""
        kind = self.of_byte[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            two = lead[data[lead] < 0xD4]             # two bytes, below PLAIN_END
            kind[two] = self.classes[((data[two] & 0x1F).astype(np.int64) << 6) | (data[two + 1] & 0x3F)]
            kind[two + 1] = kind[two]
        return kind

    def starts(self, data: np.ndarray, kind: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Whether a pre-token starts at each byte. ``texts``: where the (non-empty) texts start."""
        head = np.zeros(len(data), bool)
        head[texts] = True
        start = head.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # the last white character before something else stands alone, or with it if it is a space
        after = np.flatnonzero(start[1:] & ~head[1:] & (kind[:-1] == WHITE)) + 1
        last = after - 1
        start[last - ((data[last] & 0xC0) == 0x80)] = True
        start[after[data[last] == 0x20]] = False
        self._contractions(data, kind, start, head)
        return start

    @staticmethod
    def _contractions(data: np.ndarray, kind: np.ndarray, start: np.ndarray, head: np.ndarray) -> None:
        at = np.flatnonzero((data == 0x27) & start)
        at = at[at + 1 < len(data)]
        at = at[(kind[at + 1] == LETTER) & ~head[at + 1]]
        padded = np.append(data, np.zeros(2, np.uint8))
        ends = np.append(head, [True, True])          # a text that starts, or the end of all
        for form in CONTRACTIONS:
            hit = np.ones(len(at), bool)
            for k, byte in enumerate(form[1:], 1):
                hit &= (padded[at + k] == byte) & ~ends[at + k]
            own = at[hit]
            start[own + 1] = False
            behind = own + len(form)
            start[behind[behind < len(data)]] = True
            at = at[~hit]


class Encoder:
    """ids of whole texts; what was met lately is kept in two tables.

    A pre-token met again moves to the young table; when that is full it
    becomes the old one and the former old one goes, so that seldom ones leave
    first and both together stay within ``keep`` bytes.
    """

    def __init__(self, path: str, keep: int = 192 << 20):
        self.library = Tokenizer.from_file(path)
        self.pairs = Tokenizer(self.library.model)    # the model alone, on pre-tokens that are cut already
        self.pairs.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)     # bytes of each id
        for letters, i in vocabulary.items():
            self.width[i] = len(letters)
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.pretokens = Pretokens()
        self.keep = keep
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.young_cost = 0

    def _remember(self, word: bytes, ids: bytes) -> None:
        self.young[word] = ids
        self.young_cost += len(word) + len(ids) + KEPT_COST
        if self.young_cost > self.keep // 2:
            self.old, self.young, self.young_cost = self.young, {}, 0

    def _fresh(self, words: list[bytes]) -> list[bytes]:
        """ids of pre-tokens by the library's model. None holds what it splits at: all bytes are letters there."""
        out = []
        for at in range(0, len(words), TOGETHER):
            own = words[at:at + TOGETHER]
            strung = b"".join(own).decode("latin-1").translate(self.letters)
            ends = np.cumsum([len(w) for w in own])
            cuts = [0, *ends.tolist()]
            found = self.pairs.encode_batch_fast([" ".join(strung[a:b] for a, b in zip(cuts, cuts[1:], strict=False))],
                                                 add_special_tokens=False)[0]
            ids = np.array(found.ids, ID)
            edges = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            data, stops = ids.tobytes(), [0, *(edges * ID.itemsize).tolist()]
            out += [data[a:b] for a, b in zip(stops, stops[1:], strict=False)]
        return out

    def _table(self, words: list[bytes]) -> list[bytes]:
        """ids of the different pre-tokens of a group."""
        found = list(map(self.young.get, words))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = self.old.get(words[i])
                if ids is None:
                    missing.append(i)
                else:
                    found[i] = ids
                    self._remember(words[i], ids)
        for i, ids in zip(missing, self._fresh([words[i] for i in missing]), strict=True):
            found[i] = ids
            if len(words[i]) <= KEEP_BYTES:
                self._remember(words[i], ids)
        return found

    def _plain(self, texts: list[bytes], buffer: bytes, data: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of non-empty plain texts, one after the other, and how many each has."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        at = np.flatnonzero(self.pretokens.starts(data, kind, begins))
        edges = np.append(at, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(buffer)])
        coded = words.dictionary_encode()
        which = coded.indices.to_numpy()
        table = self._table(coded.dictionary.to_pylist())
        length = np.fromiter(map(len, table), np.int64, len(table)) // ID.itemsize
        flat = np.frombuffer(b"".join(table), ID)
        counts = length[which]
        ends = np.cumsum(counts)
        shift = (np.cumsum(length) - length)[which] - (ends - counts)
        ids = flat[np.arange(ends[-1]) + np.repeat(shift, counts)]
        text_ends = ends[np.append(np.searchsorted(at, begins[1:]), len(at)) - 1]
        return ids, np.diff(text_ends, prepend=0)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts, one text after the other, and how many each has."""
        counts = np.zeros(len(texts), np.int64)
        plain = [i for i, t in enumerate(texts) if t]
        buffer = b"".join([texts[i] for i in plain])
        data = np.frombuffer(buffer, np.uint8)
        kind = self.pretokens.kinds(data)
        odd = {i for i in plain if any(s in texts[i] for s in self.special)} if any(s in buffer for s in self.special) else set()
        foreign = np.flatnonzero(kind == FOREIGN)
        if len(foreign):
            begins = np.cumsum([0, *(len(texts[i]) for i in plain[:-1])])
            odd |= {plain[k] for k in np.unique(np.searchsorted(begins, foreign, side="right") - 1).tolist()}
        if not odd:
            if not plain:
                return np.empty(0, ID), counts
            ids, counts[plain] = self._plain([texts[i] for i in plain], buffer, data, kind)
            return ids, counts
        ids, known = self.encode([b"" if i in odd else t for i, t in enumerate(texts)])
        stops = np.cumsum(known)
        parts, done = [], 0
        for i in sorted(odd):
            parts += [ids[done:stops[i]], np.array(self.library.encode(texts[i].decode(), add_special_tokens=False).ids, ID)]
            known[i], done = len(parts[-1]), stops[i]
        return np.concatenate([*parts, ids[done:]]), known


@C.TaskCache
def encoder(path: str) -> Encoder:
    return Encoder(path)
