"""Token ids of whole texts with a public tokenizer file."""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np

#: Words longer than this, and words beyond the cache's bound, are encoded again each time.
CACHED_WORD_BYTES = 64
CACHED_WORDS = 500_000
#: Words of letters that are encoded together.
JOINED_WORDS = 512

_encoders: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts word by word, remembering the ids of words.

    Holds for tokenizers whose pre-tokenizer drops white space and never joins across it: the
    ids of a text are then the ids of its blank-separated words in order. Only ASCII white space
    splits here; any other is left to the tokenizer. If the tokenizer lower-cases, A-Z are lower-cased
    first, as fewer words differ then; not so in words that may hold a special token.
    ``encode`` returns little-endian unsigned 32-bit ids as bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.folds = '"Lowercase"' in str(self.tokenizer.to_str()[:4000])
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, dtype=bool)
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        # one mark behind letters is a word of its own for a tokenizer that ends words
        self.marks = {c.encode(): x for c, x in zip(",.!?;:", self._each(list(",.!?;:")))} if self.ends.any() else {}
        self.special = {t.content[:1].encode() for t in self.tokenizer.get_added_tokens_decoder().values()}

    def _words(self, text: str) -> list[bytes]:
        raw = text.encode("utf-8")
        if not self.folds or any(c in raw for c in self.special):
            return raw.split()
        return raw.lower().split()

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        packed = array("I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _each(self, words: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone: encoded many at a time and cut after each id that ends a word.

        A group in which the ends do not match the words is encoded word by word.
        """
        if not self.ends.any():
            return self._each(words)
        groups = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        out: list[bytes] = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(cuts) != len(group):
                out += self._each(group)
                continue
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *cuts.tolist()], cuts.tolist())]
        return out

    def _encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not known. A word of letters with a mark behind it has the ids of both parts."""
        letters, marked, other = {}, [], []
        for w in words:
            text = w.decode("utf-8")
            if text.isalpha():
                letters[w] = text
            elif w[-1:] in self.marks and text[:-1].isalpha():
                marked.append(w)
                if w[:-1] not in self.known:
                    letters[w[:-1]] = text[:-1]
            else:
                other.append((w, text))
        found = dict(zip(letters, self._letters(list(letters.values()))))
        found.update(zip([w for w, _ in other], self._each([t for _, t in other])))
        for w in marked:
            stem = w[:-1]
            found[w] = (found[stem] if stem in found else self.known[stem]) + self.marks[w[-1:]]
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null counts as empty."""
        split = [self._words(t or "") for t in texts]
        known = self.known
        # the words of these texts, each looked up once; their own small table serves the repeats
        own = {w: known.get(w) for w in set().union(*split)}
        missing = [w for w, ids in own.items() if ids is None]
        if missing:
            found = self._encode_words(missing)
            own.update(found)
            room = CACHED_WORDS - len(known)
            if room > 0:
                known.update([x for x in found.items() if len(x[0]) <= CACHED_WORD_BYTES][:room])
        get = own.__getitem__
        return [b"".join(map(get, words)) for words in split]


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
