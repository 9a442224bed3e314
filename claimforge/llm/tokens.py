"""Byte-level BPE ids of whole texts with the tokenizers library, fast enough for a whole corpus.

A text is cut before each space or line feed, if each stands alone between two other characters. The pre-tokenizer of
byte-level BPE always cuts there as well, so the pieces can be encoded one by one and kept in a bounded cache: words
repeat, and most pieces are looked up rather than encoded. Texts with other white space are split by the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: As is_regular(), for Arrow: the white space of Python besides space and line feed, or two of these in a row or at an end.
IRREGULAR = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
RARE_SPACE = re.compile(r"[^\S\n ]")
#: Fixed value: the published split pattern of byte-level BPE.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def is_regular(text: str) -> bool:
    """Whether white space is only single spaces and line feeds between other characters."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n" or RARE_SPACE.search(text))


class PieceCache:
    """Encodes texts piece by piece, with what encode_words makes of a list of pre-tokens: values that glue.join() joins.

    mark is a value that no pre-token has; it keeps the pieces apart while new ones are split by one pass of the pattern.
    Of up to 2 * most pieces and as many pre-tokens, those met lately are kept.
    """

    def __init__(self, encode_words: Callable[[list[str]], list], split: Callable[[str], list[str]], glue: str | bytes, mark: str | bytes, most: int):
        self.encode_words, self.split, self.glue, self.mark, self.most = encode_words, split, glue, mark, most
        self.feed = encode_words(["\n"])[0]
        self.words, self.old_words, self.pieces, self.old_pieces = {}, {}, {}, {}

    def _learn_words(self, words: set[str]) -> None:
        if len(self.words) > self.most:
            self.words, self.old_words = {}, self.words
        new = words.difference(self.words)
        old = self.old_words
        self.words.update([(w, old[w]) for w in new if w in old])
        new = list(new.difference(old))
        if new:
            self.words.update(zip(new, self.encode_words(new), strict=True))

    def make(self, keys: list[str]) -> list:
        """Values of keys. A key stands for a space and the key, or for itself where it starts with a line feed."""
        spaced, fed = [], []
        for k, key in enumerate(keys):
            (fed if key[0] == "\n" else spaced).append(k)
        flat = self.split("\n".join([*(f" {keys[k]}" for k in spaced), *(keys[k][1:] for k in fed)]))
        self._learn_words({w for w in set(flat) if w != "\n"})
        get = self.words.__getitem__
        values = self.glue.join([self.mark if w == "\n" else get(w) for w in flat]).split(self.glue + self.mark + self.glue)
        out = [self.mark] * len(keys)
        for k, v in zip([*spaced, *fed], values, strict=True):
            out[k] = v
        for k in fed:
            out[k] = self.glue.join([self.feed, out[k]])
        return out

    def _learn(self, keys: set[str]) -> None:
        if len(self.pieces) > self.most:
            self.pieces, self.old_pieces = {}, self.pieces
        new = keys.difference(self.pieces)
        old = self.old_pieces
        self.pieces.update([(k, old[k]) for k in new if k in old])
        missing = list(new.difference(old))
        if missing:
            self.pieces.update(zip(missing, self.make(missing), strict=True))

    def encode(self, texts: list[str | None]) -> list:
        """The value of each text; an empty or null one has an empty value."""
        keys, whole, need = [], {}, set()
        for i, text in enumerate(texts):
            own: list[str] = []
            if text and not is_regular(text):
                whole[i] = self.split(text)
            elif text:
                first, *own = text.replace("\n", " \n").split(" ")
                own = [f"\n{first}", *own]
                need.update(own)
            keys.append(own)
        self._learn(need)
        self._learn_words({w for x in whole.values() for w in x})
        get, skip, out = self.pieces.__getitem__, len(self.feed) + len(self.glue), []
        for i, own in enumerate(keys):
            if i in whole:
                out.append(self.glue.join(map(self.words.__getitem__, whole[i])))
            else:
                out.append(self.glue.join(map(get, own))[skip:])
        return out


class IdTable:
    """Known strings and their ids, as Arrow arrays of at most some `most` bytes; those not met longest go first.

    make(strings) gives the ids of new strings as a large_list<uint32>. The first entry is the empty string without ids.
    """

    def __init__(self, make: Callable[[pa.Array], pa.Array], most: int):
        self.make, self.most, self.round = make, most, 0
        self.keys = pa.array([""], pa.large_string())
        self.ids = pa.array([[]], pa.large_list(pa.uint32()))
        self.met = np.zeros(1, np.int64)

    def slots(self, keys: pa.Array) -> pa.Array:
        """Places of different strings among the known ones; they hold until the next call."""
        self.round += 1
        if self.keys.nbytes + self.ids.nbytes > self.most:
            least = np.partition(self.met[1:], len(self.met) // 2)[len(self.met) // 2]
            keep = self.met > least if least < self.round - 1 else np.arange(len(self.met)) % 2 == 0
            keep[0] = True
            self.keys, self.ids, self.met = self.keys.filter(pa.array(keep)), self.ids.filter(pa.array(keep)), self.met[keep]
        slots = pc.index_in(keys, value_set=self.keys)
        unknown = slots.is_null()
        new = keys.filter(unknown)
        if len(new):
            slots = pc.replace_with_mask(slots, unknown, pa.array(np.arange(len(self.keys), len(self.keys) + len(new), dtype=np.int32)))
            self.ids = pa.concat_arrays([self.ids, self.make(new)])
            self.keys = pa.concat_arrays([self.keys, new])
            self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[slots.to_numpy()] = self.round
        return slots

    def lists(self, keys: pa.Array) -> pa.Array:
        """The ids of every string, which may repeat."""
        coded = pc.dictionary_encode(keys)
        slots = self.slots(coded.dictionary)
        return self.ids.take(slots.take(coded.indices))


def _strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


def _nested(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(ends.astype(np.int64)), pa.array(values))


class Encoder:
    """encode(texts) gives the ids, little-endian unsigned 32-bit, that tokenizers.Tokenizer gives without special tokens added.

    The string of a special token in a text becomes that token's id, as the library does by default; with
    specials_as_text it is ordinary text. path names a byte-level BPE tokenizer file without a normalizer. Arrow cuts
    texts into pieces and finds them among known ones; Python sees only new pieces, and the library's model new words.
    """

    def __init__(self, path: str, most: int = 16 << 20, specials_as_text: bool = False):
        self.library = Tokenizer.from_file(path)
        if self.library.normalizer is not None or "ByteLevel" not in str(self.library.pre_tokenizer):
            raise ValueError("a byte-level BPE tokenizer without a normalizer is needed")
        self.library.encode_special_tokens = specials_as_text
        added = [t.content for t in self.library.get_added_tokens_decoder().values() if not (specials_as_text and t.special)]
        self.added = "|".join(map(re.escape, added))
        tokenize, alphabet = self.library.model.tokenize, dict(enumerate(byte_alphabet()))
        chars, but_feed = str.maketrans(alphabet), str.maketrans({b: c for b, c in alphabet.items() if b != 10})

        def encode_words(words: pa.Array) -> pa.Array:
            words = _strings(words)
            joined = "\n".join(words).encode().decode("latin-1").translate(but_feed).split("\n")
            if len(joined) != len(words):  # words with line feeds
                joined = [w.encode().decode("latin-1").translate(chars) for w in words]
            found = [[t.id for t in tokenize(w)] for w in joined]
            ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
            return _nested(ends, np.fromiter(chain.from_iterable(found), np.uint32, int(ends[-1])))

        self.words = IdTable(encode_words, most // 2)
        self.pieces = IdTable(self._encode_pieces, most // 2)
        self.feed = tokenize("\n".encode().decode("latin-1").translate(chars))[0].id

    def _encode_pieces(self, pieces: pa.Array, step: int = 250_000) -> pa.Array:
        """A piece stands for a space and itself, or for itself where it starts with a line feed. None holds other white space."""
        out = []
        for at in range(0, len(pieces), step):
            own = pieces.slice(at, step)
            fed = pc.starts_with(own, "\n")
            found = []
            for part, sign in ((own.filter(pc.invert(fed)), "\n "), (own.filter(fed), "")):
                if not len(part):
                    continue
                # every piece follows a line feed, whose id belongs to the piece or goes
                flat = pa.array(SPLIT.findall(sign + sign.join(_strings(part))), pa.large_string())
                feeds = np.flatnonzero(pc.equal(flat, "\n").to_numpy(zero_copy_only=False))
                lists = self.words.lists(pc.if_else(pc.equal(flat, "\n"), "", flat) if sign else flat)
                ends = lists.offsets.to_numpy()
                found.append(_nested(np.append(ends[feeds], ends[-1]) - ends[0], lists.values.to_numpy()[ends[0] : ends[-1]]))
            places = np.concatenate([np.flatnonzero(~fed.to_numpy(zero_copy_only=False)), np.flatnonzero(fed.to_numpy(zero_copy_only=False))])
            out.append(pa.concat_arrays(found).take(pa.array(np.argsort(places))))
        return pa.concat_arrays(out)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; a null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        out: list[bytes] = [b""] * len(texts)
        special = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False) if self.added else np.zeros(len(texts), bool)
        for i in np.flatnonzero(special).tolist():
            out[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        odd = pc.match_substring_regex(texts, IRREGULAR).to_numpy(zero_copy_only=False) & ~special
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.words.lists(pa.array(SPLIT.findall(texts[i].as_py()), pa.large_string())).flatten().to_numpy().tobytes()
        plain = np.flatnonzero(~odd & ~special)
        if not len(plain):
            return out
        # " \nfirst second \nthird": the piece before the first space is empty, and the first line feed's id goes
        fed = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), texts.take(pa.array(plain)), pa.scalar("", pa.large_string()))
        lists = pc.split_pattern(pc.replace_substring(fed, "\n", " \n"), " ")
        found = self.pieces.lists(lists.flatten())
        ids, starts = found.values.to_numpy(), found.offsets.to_numpy()
        ends = starts[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for i, start, end in zip(plain.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i] = ids[start + 1 : end].tobytes()
        del found, ids, lists, fed
        pa.default_memory_pool().release_unused()  # workers share an executor's memory
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of a Python worker, which its tasks share: the tokenizer is loaded once, and known pieces stay known."""
    return Encoder(path)
