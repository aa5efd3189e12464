"""Template residue, filler and error pages in text.

Records of one template are aligned over the whole corpus, in two forms.

* Slots. The two words before and the two words after a position are the template
  around it. Positions that hold a placeholder, the name of a missing value, a
  bare variable name or a visible gap are candidates; then all records are read
  again for what they have in the same place, filled (up to four words) or blank.
  A place whose values differ between different texts is a slot. In a slot,
  candidates are residue, and so are blanks and defaults (the name of the slot's
  variable as its value). A missing value's name that is the same in many
  texts with no filling anywhere is the template's wording. Placeholder syntax
  whose template no other record has can't be aligned; its form decides alone.
* Whole pages. A sentence with the vocabulary of error, script or sample pages is
  a cue. Sentences that the corpus shows practically only beside cues belong to
  the template of such pages, whatever they say. A page is residue if it has
  a cue, filler or mash and no sentence beyond those templates; so is a short page
  that is served word for word under many addresses.

Defined results: NULL and blank texts are no residue; a text is judged whole,
whatever its length; repeated documents are judged alike; status codes and
other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockline.llm import lexicon
from dockline.session import cut_lineage

#: Different texts in which an unchanging name of a missing value, never filled, counts as wording.
ALIGNED = 8
#: Of a sentence of page templates: different texts it stands in, share of them without foreign sentences, share beside a cue.
REPEATED, PURITY, BESIDE = 3, 0.95, 0.2
#: Different fillings that prove a slot for blanks and bare names; addresses of a page served word for word, and the words it may have.
PROOF, ADDRESSES, SHORT = 3, 8, 120
_SALT = 16
#: Hashes looked for in one reading of the texts. More are looked for in further readings, each for a share of the hashes.
_LOOKED, _BITS = 1 << 21, 1 << 24
#: The longest filling in words, and the words of a field's label, which explains nothing whatever its words.
_FILL, _LABEL = 4, 5
#: Words in headings, tables and lists that are content without a full stop.
_LISTING = 40
#: Characters worked on at a time, and words a worker remembers.
_PIECE, _WORDS = 1 << 19, 300_000

_NAME = r"[A-Za-z]\w*(?:[.\-][A-Za-z]\w*)*"
#: A prompt ends with its bracket or its line; another bracket opening ends the search, so a line is read once.
_CALL = rf"(?:{lexicon.PROMPT_STARTS})\b[^\[\]{{}}()<>_\n]*|[^\[\]{{}}()<>_\n]+\s(?:{lexicon.PROMPT_ENDS})"
#: Marked tokens that may be anything: alone they say nothing, the alignment decides.
_SOFT = r"\[(?!(?:CLS|SEP|MASK|PAD|UNK|BOS|EOS)\])[^\W\d][^\[\]\n]*\]|<[^\W\d][^<>\n]*>|\{[^{}\n]+\}|%[A-Za-z]\w*%|_{4,}"
_FORMS = [
    rf"\{{\{{\{{?\s*{_NAME}\s*\}}?\}}\}}", rf"\$\{{\s*{_NAME}\s*\}}", rf"#\{{\s*{_NAME}\s*\}}", rf"\{{\$\s*{_NAME}\s*\}}", rf"\{{\s*{_NAME}\s*(?:\|\s*\w+\s*)?\}}",
    rf"<%=?\s*\$?{_NAME}\s*%>", rf"<\?=?\s*\$?{_NAME}\s*\?>", rf"\{{%\s*(?:if\s+)?{_NAME}\s*%\}}", rf"\[%\s*{_NAME}\s*%\]", rf"\[\[\s*{_NAME}\s*\]\]",
    rf"%%{_NAME}%%", rf"##{_NAME}##", rf"(?<!\w)__{_NAME}?[A-Za-z0-9]__(?!\w)", rf"~{_NAME}~", rf"\${_NAME}\$", rf"@@{_NAME}@@", rf"@\({_NAME}\)", rf"\*\|{_NAME}\|\*", rf"%\({_NAME}\)s",
    rf"&(?!(?:{lexicon.ENTITIES});){_NAME};", rf"(?<![\w:]):{_NAME}:(?![\w:])",
    rf"\[\s*(?:{_CALL})\s*\]", rf"\{{\s*(?:{_CALL})\s*\}}", rf"\(\s*(?:{_CALL})\s*\)", rf"<\s*(?:{_CALL})\s*>", rf"(?<!\w)_\s*(?:{_CALL})\s*_(?!\w)",
    lexicon.MISSING_MARKS,
]
_CANDIDATE = re.compile("|".join(f"(?:{f})" for f in _FORMS) + rf"|(?P<weak>(?<![\w/.#\-]){lexicon.MISSING_WORDS}(?![\w/\-]))|(?P<soft>{_SOFT})")
#: What any candidate has: cheap test of a text and of a line before the full pattern.
_HINT = re.compile(rf"[\[{{<@~]|\w\$|\$\w+\$|%[\w%(]|##|#N/A|#REF|__|_ ?[A-Z]|\*\||&\w|:[A-Za-z][\w.\-]*:|\?\?\?|\((?:null|[A-Z ])|N/A-|missing_|{lexicon.MISSING_WORDS}")
_PROMPT = re.compile(rf"\s*(?:{_CALL})")
_ENDS = re.compile(r"[.!?…。][\"'»”)]*$")
_TRIM = "\"'.,;:!?()[]{}<>|·«»“”…-–—*"
_ODD, _NUMBER, _LETTERS = re.compile(r"[^\x21-\x7e]+"), re.compile(r"\d+(?:[.,]\d+)*"), re.compile(r"[^a-z]+")
#: What only programs write.
_REPORT = re.compile(r"^traceback$|.exception$|^\w+error$|^sqlstate|^ora-#$|^errno")
_BARE = re.compile(r"[a-z]+(?:_[a-z]+)+|[A-Z]{2,}(?:_[A-Z]{2,})+|[a-z]{2,}[A-Z][a-z]+(?:[A-Z][a-z]+)*|[A-Z]{6,}")

(_LINE, _GAP, _WORD, _END, _MARK, _THING, _FAILURE, _ACTION, _SCRIPT, _SAMPLE, _LATIN, _PROSE, _MASHED, _FRAME, _EXPLAINS, _IDENT, _MASKED, _LONG, _MACHINE, _CAPTION) = (1 << (32 + i) for i in range(20))
_CLASSES = ((_THING, lexicon.THINGS), (_FAILURE, lexicon.FAILURES), (_ACTION, lexicon.ACTIONS), (_SCRIPT, lexicon.SCRIPTS), (_SAMPLE, lexicon.SAMPLES), (_LATIN, lexicon.LATIN), (_FRAME, lexicon.FRAMES), (_CAPTION, lexicon.CAPTIONS), (_EXPLAINS, lexicon.EXPLAINING))
_TOKEN = "\x00"
KINDS = ("error", "scripts", "sample", "filler", "mash")


def _plain(word: str) -> str:
    """A word without case, outer marks, digits and anything that a wrong charset could have changed."""
    return _NUMBER.sub("#", _ODD.sub("*", word.replace("’", "'").strip(_TRIM).lower()))


_STEPS = {a + b for row in lexicon.ROWS for r in (row, row[::-1]) for a, b in zip(r, r[1:])}


def _mash(word: str) -> bool:
    """Typed without sense: one letter again and again, or strokes of at least three neighbouring keys only."""
    if word in lexicon.MASH:
        return True
    if len(word) < 3 or not word.isascii() or not word.replace(";", "").isalpha() or word in ("www", "iii"):
        return False
    if len(set(word)) == 1:
        return True
    strokes, n = [], 1
    for a, b in zip(word, word[1:]):
        if a + b in _STEPS:
            n += 1
        else:
            strokes.append(n)
            n = 1
    return len(word) >= 4 and min([*strokes, n]) >= 3 or (len(word) == 3 and n == 3)


class _Tokens(dict):
    """Token to one number: hash of the plain word below, classes above."""

    def __missing__(self, raw: str) -> int:
        value = self._made(raw)
        self[raw] = value
        return value

    @staticmethod
    def _made(raw: str) -> int:
        if raw == "\n":
            return _LINE
        if raw == _TOKEN:
            return _WORD | _MARK | 0x5A5A5A5A
        word = _plain(raw)
        end = _END if _ENDS.search(raw) else 0
        if not word:
            return end | (_GAP if raw in ("", ",", ".") else 0)
        # a word without a letter that charsets share stands for itself, else all texts of other scripts would look alike
        out = _WORD | end | zlib.crc32((word if re.search("[a-z0-9#]", word) else raw).encode("utf-8", "replace"))
        for flag, words in _CLASSES:
            if word in words:
                out |= flag
        if out & _LATIN and len(word) >= 4:
            out |= _PROSE
        if word.startswith("cookie"):
            out |= _FRAME
        if _REPORT.search(word):
            out |= _MACHINE | _FAILURE
        if _mash(word):
            out |= _MASHED
        if "#" in word:
            out |= _MASKED
        if _BARE.fullmatch(raw.strip(_TRIM)):
            out |= _IDENT
        if word.count("*") and len(raw) >= 12 and sum(c > "⹿" for c in raw) * 2 > len(raw):
            out |= _LONG
        return out


def _hash(text: str) -> int:
    b = text.encode("utf-8", "replace")
    return (zlib.crc32(b) << 31) ^ zlib.adler32(b)


_M1, _M2, _M3, _KEEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x7FFF_FFFF_FFFF_FFFF)
_OPEN, _SHUT = np.uint64(0x1111_2222), np.uint64(0x3333_4444)
_POWERS = np.cumprod(np.full(4096, _M2, dtype=np.uint64))


def _mix(a, b):
    x = (a * _M1) ^ (b + _M3)
    x = (x ^ (x >> np.uint64(29))) * _M2
    return (x ^ (x >> np.uint64(32))) & _KEEP


class _Wanted:
    """A set of hashes as bits: of fixed size, so it may hold a few more, which the joins sort out."""

    def __init__(self, size: int = _BITS):
        self.bits = np.zeros(size, dtype=bool)

    def add(self, hashes) -> "_Wanted":
        self.bits[np.asarray(hashes, dtype=np.int64) % len(self.bits)] = True
        return self

    def __contains__(self, _) -> bool:
        raise TypeError

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[(hashes % np.uint64(len(self.bits))).astype(np.int64)]


class Piece:
    """Words and sentences of some stretches of text, as arrays over all of them."""

    def __init__(self, tokens: _Tokens, texts: list[str], owners: list[int]):
        #: what was found in each text, in the order of the marks that stand for it
        self.found: list[tuple[str, str | None]] = []
        raws: list[str] = []
        lengths = []
        for t in texts:
            for odd in "\t\r\f\v\xa0":
                if odd in t:
                    t = t.replace(odd, " ")
            if _TOKEN in t:
                t = t.replace(_TOKEN, " ")
            if _HINT.search(t):
                t = "\n".join(self._masked(line) if _HINT.search(line) else line for line in t.split("\n"))
            toks = t.replace("\n", " \n ").split(" ")
            toks.append("\n")
            lengths.append(len(toks))
            raws += toks
        self.raws = raws
        packed = np.fromiter(map(tokens.__getitem__, raws), dtype=np.int64, count=len(raws))
        is_word = packed & _WORD != 0
        edge = packed & (_LINE | _END) != 0
        sentence = np.cumsum(edge) - edge
        self.at = np.flatnonzero(is_word)
        self.code = (packed[self.at] & 0xFFFF_FFFF).astype(np.uint64)
        self.flags = packed[self.at]
        owner = np.repeat(np.asarray(owners, dtype=np.int64), lengths)
        sid = sentence[self.at]
        # first word of each sentence that has words
        self.start = np.flatnonzero(np.r_[True, sid[1:] != sid[:-1]]) if len(sid) else np.zeros(0, dtype=np.int64)
        self.n = np.diff(np.r_[self.start, len(sid)])
        self.owner = owner[self.at[self.start]] if len(sid) else np.zeros(0, dtype=np.int64)
        self.line = np.cumsum(packed & _LINE != 0)[self.at[self.start]] if len(sid) else self.start
        ended = (packed[np.flatnonzero(edge)] & _END) != 0
        self.ended = ended[sid[self.start]] if len(sid) else np.zeros(0, dtype=bool)
        self.which = np.repeat(np.arange(len(self.start)), self.n)
        place = np.arange(len(sid)) - np.repeat(self.start, self.n)
        self.first, self.last = place == 0, place == np.repeat(self.n, self.n) - 1
        self.place = place
        # a gap shows if exactly one empty or bare comma or stop token stands before a word inside its sentence
        gap = packed & _GAP != 0
        self.gap = np.zeros(len(sid), dtype=bool)
        inner = ~self.first
        self.gap[inner] = gap[self.at[inner] - 1] & is_word[np.maximum(self.at[inner] - 2, 0)]
        with np.errstate(over="ignore"):
            if len(sid):
                self.digest = np.add.reduceat(self.code * _POWERS[place % 4096], self.start) & _KEEP
            else:
                self.digest = np.zeros(0, dtype=np.uint64)

    def _masked(self, line: str) -> str:
        def mask(m: re.Match) -> str:
            value = m.group()
            inner = value[1:-1]
            if value[0] in "[{(<_" and " " in inner.strip() and m.lastgroup is None and any(c.islower() for c in inner) and _PROMPT.match(inner):
                return value
            self.found.append((value, m.lastgroup))
            return f" {_TOKEN} "

        return _CANDIDATE.sub(mask, line)

    def total(self, flag: int) -> np.ndarray:
        """Words of a class in each sentence."""
        return np.add.reduceat((self.flags & flag != 0).astype(np.int32), self.start) if len(self.start) else np.zeros(0, dtype=np.int32)

    def kinds(self) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """Masks over the sentences: cues by kind, content, and what is neither."""
        n = self.n
        thing, failure, action, script = self.total(_THING), self.total(_FAILURE), self.total(_ACTION), self.total(_SCRIPT)
        explains = (self.total(_EXPLAINS) > 0) | (self.total(_MARK) > 0)
        telling = np.add.reduceat((self.flags & (_THING | _FAILURE | _ACTION | _SCRIPT) != 0).astype(np.int32), self.start) if len(self.start) else n
        dense = (telling * 4 >= n) & ~explains
        cue = {
            "error": (dense & ((failure >= 2) | ((failure >= 1) & ((thing >= 1) | (n <= 2))))) | ((self.total(_MACHINE) > 0) & (n <= 12) & (self.total(_EXPLAINS) == 0)),
            "scripts": (telling * 4 >= n) & ~explains & (script >= 1) & (telling >= 2) & ((action + failure >= 1) | (n <= 5)),
            "sample": (self.total(_SAMPLE) >= 2) & (self.total(_SAMPLE) * 2 >= n - self.total(_MASKED)) | (self.total(_CAPTION) > 0) & (n <= 2),
        }
        pairs = np.unique(np.stack([self.which.astype(np.uint64), self.code]), axis=1)[0].astype(np.int64) if len(self.which) else np.zeros(0, dtype=np.int64)
        different = np.bincount(pairs, minlength=len(n))
        cue["filler"] = ((n >= 2) & ((self.total(_LATIN) * 10 >= n * 6) | ((self.total(_PROSE) * 4 >= n) & (n >= 6)))) | ((n >= 6) & (different * 3 <= n) & (self.total(_MASKED) == 0))
        # beside a sentence that is mostly filler, one with some of it is filler as well
        beside = np.zeros(int(self.owner.max()) + 1 if len(n) else 0, dtype=bool)
        beside[self.owner[cue["filler"] & (self.total(_PROSE) >= 3)]] = True
        cue["filler"] |= beside[self.owner] & (self.total(_PROSE) * 10 >= n)
        cue["mash"] = (n >= 2) & (self.total(_MASHED) * 10 >= n * 6)
        # what the reader is asked to do: with a failure a message by itself, else no content
        asks = dense & (action >= 1) & (action + thing + failure >= 3)
        cue["error"] |= asks & (failure >= 1)
        any_cue = np.zeros(len(n), dtype=bool)
        for m in cue.values():
            any_cue |= m
        frame = (self.total(_FRAME) > 0) | asks
        content = ((self.ended & (n >= 4)) | (self.total(_LONG) > 0)) & ~any_cue & ~frame
        return cue, content, ~(any_cue | frame | content)

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Per word: the template of the two words before it, and of it and the word after it."""
        w = self.code
        before = np.where(self.place >= 1, np.roll(w, 1), _OPEN)
        earlier = np.where(self.place >= 2, np.roll(w, 2), _OPEN)
        after = np.where(self.last, _SHUT, np.roll(w, -1))
        with np.errstate(over="ignore"):
            return _mix(earlier, before), _mix(w, after)

    def text(self, a: int, b: int) -> str:
        return " ".join(self.raws[self.at[a] : self.at[b - 1] + 1])


_END_SIDE = None


def _end_side():
    with np.errstate(over="ignore"):
        return _mix(np.array([_SHUT]), np.array([_SHUT]))[0]


def _letters(text: str) -> int:
    """Hash of a value's letters: a variable's name and the same name written out are equal."""
    return _hash(_LETTERS.sub("", text.lower()))


class PageScanner:
    """Reads pages in pieces; made once per Python worker."""

    def __init__(self) -> None:
        self.tokens = _Tokens()

    def pieces(self, texts: list[str | None]) -> Iterator[Piece]:
        """Long texts are cut at line ends; a sentence never goes over one."""
        part: list[str] = []
        owners: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            at = 0
            while t and at < len(t):
                stop = len(t)
                if stop - at > _PIECE:
                    cut = t.find("\n", at + _PIECE)
                    stop = cut + 1 if cut >= 0 else stop
                part.append(t[at:stop])
                owners.append(i)
                size += stop - at
                at = stop
                if size >= _PIECE:
                    yield self._piece(part, owners)
                    part, owners, size = [], [], 0
        if part:
            yield self._piece(part, owners)

    def _piece(self, part: list[str], owners: list[int]) -> Piece:
        out = Piece(self.tokens, part, owners)
        if len(self.tokens) > _WORDS:
            self.tokens.clear()
        return out

    def pages(self, texts: list[str | None]) -> dict[str, list]:
        """Columns of what every page says by itself."""
        count = len(texts)
        cues = np.zeros((len(KINDS), count), dtype=np.int64)
        content, rest, words, telling, numbered = (np.zeros(count, dtype=np.int64) for _ in range(5))
        hashes: list[list[np.ndarray]] = [[] for _ in range(count)]
        slots: list[list[tuple]] = [[] for _ in range(count)]
        for p in self.pieces(texts):
            cue, full, neither = p.kinds()
            for k, name in enumerate(KINDS):
                np.add.at(cues[k], p.owner[cue[name]], 1)
            np.add.at(content, p.owner[full], 1)
            np.add.at(words, p.owner, p.n)
            np.add.at(rest, p.owner[neither], p.n[neither])
            told = ~(full | neither)
            np.add.at(telling, p.owner[told], p.n[told])
            np.add.at(numbered, p.owner[full & (p.total(_MASKED) > 0)], 1)
            where = np.flatnonzero(full)
            owners = p.owner[where]
            for o, h in zip(owners[np.r_[True, owners[1:] != owners[:-1]]] if len(owners) else [], np.split(p.digest[where], np.flatnonzero(owners[1:] != owners[:-1]) + 1)):
                hashes[o].append(h)
            self._slots(p, slots)
        filled = [np.concatenate(h) if h else np.zeros(0, dtype=np.uint64) for h in hashes]
        unique = [np.unique(h) for h in filled]
        # the same few sentences over and over stand in place of content
        again = np.array([len(f) >= 3 and len(u) * 3 <= len(f) for f, u in zip(filled, unique)], dtype=bool) & (numbered == 0)
        cues[KINDS.index("filler"), again] += 1
        content[again] = 0
        # headings, tables and lists without a full stop are content when there is much more of them than of cues
        content[(rest >= _LISTING) & (rest > 3 * telling) & (content == 0)] += 1
        total = cues.sum(axis=0)
        suspect = (total > 0) & (content <= 9 * total)
        return {
            "kinds": [[KINDS[k] for k in np.flatnonzero(cues[:, i])] for i in range(count)], "content": content, "suspect": suspect, "words": words,
            "templates": [u.astype(np.int64).tolist() if suspect[i] else [] for i, u in enumerate(unique)], "slots": slots}

    def _slots(self, p: Piece, slots: list[list[tuple]]) -> None:
        """Candidates of each page: its masked values, bare variable names, and visible gaps."""
        marked = np.flatnonzero(p.flags & _MARK != 0)
        bare = np.flatnonzero((p.flags & _IDENT != 0) & (p.n[p.which] >= 3)) if len(p.which) else marked
        gaps = np.flatnonzero(p.gap)
        if not (len(marked) or len(bare) or len(gaps)):
            return
        left, right = p.sides()
        explains = p.flags & _EXPLAINS != 0
        shut = _end_side()
        many = np.bincount(p.owner[p.which[gaps]], minlength=len(slots)) if len(gaps) else None
        long = np.bincount(p.owner, weights=p.n, minlength=len(slots)) if len(gaps) else None
        alone = np.bincount(p.which[bare], minlength=len(p.n)) if len(bare) else None

        def add(i: int, upto: int, value: int, name: int, kind: str, explained: bool) -> None:
            s = p.which[i]
            end = p.start[s] + p.n[s]
            empty = p.first[i] and upto == end
            r = right[upto] if upto < end else shut
            with np.errstate(over="ignore"):
                context = 0 if empty else int(_mix(left[i], r))
            slots[p.owner[s]].append((0 if p.first[i] else int(left[i]), 0 if upto == end else int(r), value, name, kind, explained, int(left[i]), context))

        for i, (value, group) in zip(marked, p.found):
            s = p.which[i]
            a, b = p.start[s], p.start[s] + p.n[s]
            before, after = explains[a:i].any(), explains[i + 1 : b].any()
            label = before and p.raws[p.at[i - 1]].endswith(":") and i - a <= _LABEL and not (p.flags[a:i] & _MARK).any()
            add(i, i + 1, _hash(value), _letters(value), group or "form", bool(after or (before and not label)))
        for i in bare:
            if alone[p.which[i]] == 1:
                raw = p.raws[p.at[i]]
                add(i, i + 1, _hash(raw), _letters(raw), "bare", False)
        for i in gaps:
            o = p.owner[p.which[i]]
            # gaps all over a page are its habit
            if many[o] <= max(3, long[o] // 100) and not p.flags[i] & _MARK and not p.flags[i - 1] & _MARK:
                add(i, i, 0, 0, "blank", False)

    def aligned(self, texts: list[str | None], lefts: _Wanted, contexts: _Wanted, templates: _Wanted, turn: int = 0, turns: int = 1) -> list[tuple[int, bool, int, int, int, int]]:
        """(page, whether a sentence, hash, value, times, others): values in the contexts looked for, and the sentences looked for.

        A sentence's value is the number of content sentences of its page; ``times`` of
        them are this one, and ``others`` of those due in this turn aren't looked for.
        """
        out: list[tuple[int, bool, int, int, int, int]] = []
        hits: Counter[tuple[int, int]] = Counter()
        says, others, rest = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
        shut = _end_side()
        for p in self.pieces(texts):
            if not len(p.at):
                continue
            _, full, neither = p.kinds()
            due = full & _due(p.digest, turn, turns)
            hit = due & templates.has(p.digest)
            hits.update(zip(p.owner[hit].tolist(), p.digest[hit].astype(np.int64).tolist()))
            np.add.at(says, p.owner[full], 1)
            np.add.at(others, p.owner[due & ~hit], 1)
            np.add.at(rest, p.owner[neither], p.n[neither])
            left, right = p.sides()
            here = np.flatnonzero(lefts.has(left))
            if not len(here):
                continue
            end = (p.start + p.n)[p.which[here]]
            clean = np.ones(len(here), dtype=bool)
            for k in range(1, _FILL + 1):
                stop = here + k
                inside = stop <= end
                clean &= inside & (p.flags[np.minimum(stop - 1, len(p.flags) - 1)] & _MARK == 0)
                r = np.where(stop < end, right[np.minimum(stop, len(right) - 1)], shut)
                with np.errstate(over="ignore"):
                    c = _mix(left[here], r)
                for j in np.flatnonzero(clean & contexts.has(c) & ~(p.first[here] & (stop == end))):
                    out.append((int(p.owner[p.which[here[j]]]), False, int(c[j]), _letters(p.text(here[j], stop[j])) or 1, 1, 0))
        # a long listing is one more that isn't looked for
        says[rest >= _LISTING] += 1
        others[rest >= _LISTING] += 1
        return out + [(o, True, h, int(says[o]), n, int(others[o])) for (o, h), n in hits.items()]


_scanner: list[PageScanner] = []


def _worker() -> PageScanner:
    if not _scanner:
        _scanner.append(PageScanner())
    return _scanner[0]


_SLOT = ("l", "r", "v", "name", "kind", "explained", "side", "context")


def scan(documents: DataFrame, key: str, text: str, url: str | None = None) -> DataFrame:
    """(key, path, kinds, content, suspect, words, templates, slots, digest): what each page says by itself.

    Without ``url`` every record counts as an address of its own, but then its page must have a cue to be told from mirrors.
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = f"key {kind}, path bigint, kinds array<string>, content int, suspect boolean, words int, templates array<bigint>, slots array<struct<l:bigint,r:bigint,v:bigint,name:bigint,kind:string,explained:boolean,side:bigint,context:bigint>>, digest bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            out = pd.DataFrame({"key": b["key"], "path": b["path"], **_worker().pages(texts)}, copy=False)
            out["slots"] = [[dict(zip(_SLOT, s)) for s in row] for row in out["slots"]]
            out["digest"] = [_hash(t) for t in texts]
            yield out

    address = F.col(key) if url is None else F.coalesce(F.regexp_replace(F.col(url), r"^[a-z]+://[^/?#]*|[?#].*$", ""), F.lit(""))
    return documents.select(F.col(key).alias("key"), F.xxhash64(address).alias("path"), F.col(text).alias("text")).where("text is not null").mapInPandas(run, schema)


def _due(hashes: np.ndarray, turn: int, turns: int) -> np.ndarray:
    """Which hashes belong to this turn, as in ``_share``."""
    return (hashes >> np.uint64(40)) % np.uint64(turns) == np.uint64(turn)


def _share(column: str, turn: int, turns: int) -> str:
    return f"pmod(shiftright({column}, 40), {turns}) = {turn}"


def _wanted(hashes: list[tuple[DataFrame, str]], turn: int, turns: int) -> list[bytes]:
    """The bits of each set of hashes that belong to this turn, packed; of one size whatever the number of hashes."""
    out = []
    for rows, column in hashes:
        at = f"pmod({column}, {_BITS})"
        words = rows.where(_share(column, turn, turns)).groupBy(F.expr(f"cast({at} div 32 as int)").alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({at} % 32 as int)))").alias("b"))
        bits = np.zeros(_BITS // 32, dtype=np.uint32)
        for r in words.toLocalIterator():
            bits[r.w] = r.b
        out.append(zlib.compress(bits.tobytes(), 1))
    return out


def alignments(documents: DataFrame, key: str, text: str, slots: DataFrame, templates: DataFrame) -> DataFrame:
    """(key, is_sentence, h, v, times, others, digest): what all records have in the contexts of candidates, and where the sentences of doubtful pages stand.

    The hashes looked for go to the workers as bits of a fixed size. More than
    ``_LOOKED`` of them are dealt out over several readings of the texts. A reading
    can't tell what another one finds on a page, so ``others`` is only those it is
    sure of; all of them are found by counting ``times`` against ``v``.
    """
    around, sought = slots.where("context <> 0").select("side", "context").distinct(), templates.select("template").distinct()
    turns = -(-max(around.count(), sought.count(), 1) // _LOOKED)
    schema = f"key {documents.schema[key].dataType.simpleString()}, is_sentence boolean, h bigint, v bigint, times bigint, others bigint, digest bigint"
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null and key is not null")

    def reading(turn: int) -> DataFrame:
        # a context's left side is looked for in the turn of its context
        now = around.where(_share("context", turn, turns))
        packed = [*_wanted([(now.select(F.col("side").alias("h")), "h")], 0, 1), *_wanted([(around, "context"), (sought, "template")], turn, turns)]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            wanted = []
            for bits in packed:
                w = _Wanted(0)
                w.bits = np.unpackbits(np.frombuffer(zlib.decompress(bits), dtype=np.uint8), bitorder="little").astype(bool)
                wanted.append(w)
            for b in batches:
                keys, raw = b["key"].tolist(), b["text"].tolist()
                rows = set(_worker().aligned(raw, *wanted, turn, turns))
                digests = {o: _hash(raw[o]) for o in {r[0] for r in rows}}
                yield pd.DataFrame([(keys[o], *row, digests[o]) for o, *row in rows], columns=["key", "is_sentence", "h", "v", "times", "others", "digest"])

        return texts.mapInPandas(run, schema)

    out = reading(0)
    for turn in range(1, turns):
        out = out.unionByName(reading(turn))
    return out


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALT - 1))))


def _salt(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(_SALT)).cast("int")


def residual_slots(slots: DataFrame, filled: DataFrame) -> DataFrame:
    """(key, how) of pages with an unfilled slot: ``aligned``, or ``form`` where only the form of a placeholder decides.

    Statistics per template are partial aggregates over different texts; they are
    joined over salts, so that a template on a third of all pages isn't one
    task. ``filled`` has the aligned records (key, context, v, digest).
    """
    hard = slots.where("kind in ('form', 'weak')")
    # 1. candidates against candidates, on either side of the slot
    plain = hard.where("not explained")
    sides = plain.select("key", "digest", "no", "v", "kind", F.explode(F.array("l", "r")).alias("template")).where("template <> 0")
    texts = sides.groupBy("template", "digest").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    stats = texts.groupBy("template").agg((F.min("low") != F.max("high")).alias("varies"), (F.count("*") >= ALIGNED).alias("often"))
    judged = sides.withColumn("salt", _salt("key", "no")).join(_salted(stats), ["template", "salt"])
    per = judged.groupBy("key", "no", "kind").agg(F.max("varies").alias("varies"), F.max(F.col("often") & ~F.col("varies")).alias("wording"))
    # 2. candidates against fillings of the same context
    values = filled.groupBy("context", "digest").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.collect_set("v").alias("vs"))
    opened = values.groupBy("context").agg((F.min("low") != F.max("high")).alias("differ"), F.count("*").alias("texts"), F.approx_count_distinct("low").alias("fillings")).where("differ and texts >= 2")
    blanks = slots.where("kind in ('bare', 'blank')").groupBy("context").agg(F.approx_count_distinct("digest").alias("unfilled"))
    proof = opened.join(blanks, "context", "left").select("context", ((F.col("fillings") >= PROOF) & (F.col("texts") > F.coalesce("unfilled", F.lit(0)))).alias("proved"))
    proof = proof.join(slots.where("context <> 0").select("context").distinct(), "context", "left_semi")
    inside = slots.where("context <> 0").select("key", "context", "kind").withColumn("salt", _salt("key")).join(_salted(proof), ["context", "salt"])
    in_slot = inside.where("kind in ('form', 'weak', 'soft') or proved").select("key")
    # 3. defaults: the name of a variable of the slot stands there as its value
    names = slots.where("context <> 0 and name <> 0 and kind <> 'weak'").select("context", F.col("name").alias("v")).distinct()
    defaults = filled.withColumn("salt", _salt("key")).join(_salted(names), ["context", "v", "salt"]).select("key", "context").distinct()
    defaults = defaults.withColumn("salt", _salt("key")).join(_salted(proof.where("proved")), ["context", "salt"]).select("key")
    aligned = per.where("varies").select("key").unionByName(in_slot).unionByName(defaults)
    # 4. a placeholder's form where the template stands alone
    alone = plain.where("kind = 'form' or (l = 0 and r = 0)").select("key").unionByName(per.where("not wording").select("key"))
    return aligned.select("key", F.lit("aligned").alias("how")).unionByName(alone.select("key", F.lit("form").alias("how"))).groupBy("key").agg(F.min("how").alias("how"))


def _foreign(texts: DataFrame, listed: DataFrame, known: bool = True) -> DataFrame:
    """(digest, foreign): whether a text says more than its known sentences: the listed ones, or else those that aren't listed."""
    found = texts.withColumn("salt", _salt("digest")).join(_salted(listed.withColumn("is_one", F.lit(True))), ["sentence", "salt"], "left")
    counted = F.when(F.col("is_one").isNotNull() == F.lit(known), F.col("times")).otherwise(0)
    return found.groupBy("digest").agg((F.sum(counted) < F.max("says")).alias("foreign"))


def page_templates(inside: DataFrame, outside: DataFrame, beside: DataFrame) -> DataFrame:
    """(sentence) that the corpus shows practically only on pages of such sentences and cues.

    ``inside`` has (sentence, times, says, digest) of the texts that say only what
    stands on doubtful pages: how often they say the sentence, and how many content
    sentences they have; ``outside`` (sentence, digest) of other texts; ``beside``
    (sentence, digest) where it stands beside a cue. In each round a page is foreign
    if it has a sentence outside of the templates; a sentence too often on foreign
    pages isn't one. Different texts count.
    """
    support = beside.distinct().groupBy("sentence").agg(F.count("*").alias("k"))
    # pages with other sentences stay foreign: their rows are only counted, once
    n0 = outside.distinct().groupBy("sentence").agg(F.count("*").alias("n0"))
    known = cut_lineage(support.join(n0, "sentence", "left").na.fill(0, ["n0"]))
    templates = None
    for _ in range(3):
        marked = inside.withColumn("foreign", F.lit(False)) if templates is None else inside.join(_foreign(inside, templates), "digest")
        counts = marked.groupBy("sentence").agg(F.count("*").alias("n1"), F.count_if("foreign").alias("f1"))
        n = F.col("n0") + F.col("n1")
        templates = cut_lineage(
            counts.join(known, "sentence").where((n >= REPEATED) & (F.col("n0") + F.col("f1") <= (1 - PURITY) * n) & (F.col("k") >= BESIDE * n)).select("sentence"))
    return templates


def residual_pages(pages: DataFrame, sentences: DataFrame, addressed: bool) -> DataFrame:
    """(key, how) of pages in place of content: ``cues`` only, ``template`` sentences, or ``addresses``: one text under many."""
    bare = pages.where((F.size("kinds") > 0) & (F.col("content") == 0)).select("key", F.lit("cues").alias("how"))
    beside = pages.where("suspect and content > 0").select(F.explode("templates").alias("sentence"), "digest")
    # what one reading left open: sentences due in others, and strays whose hashes only share a bit
    open_texts = cut_lineage(sentences.where("others = 0").select("sentence", "times", "says", "digest").distinct())
    strays = open_texts.select("sentence").distinct().join(beside.select("sentence").distinct(), "sentence", "left_anti")
    settled = cut_lineage(open_texts.join(_foreign(open_texts, strays, known=False), "digest"))
    inside = settled.where("not foreign").drop("foreign")
    outside = sentences.where("others > 0").select("sentence", "digest").unionByName(settled.where("foreign").select("sentence", "digest"))
    known = page_templates(inside, outside, beside)
    filled = _foreign(inside, known).where("not foreign").select("digest")
    whole = (
        sentences.where("others = 0").select("key", "digest").withColumn("salt", _salt("key")).join(_salted(filled), ["digest", "salt"])
        .select("key", F.lit("template").alias("how")).distinct())
    short = pages.where((F.col("content") > 0) & (F.col("words") <= SHORT) & (F.lit(addressed) | F.col("suspect"))).select("key", "digest", "path")
    many = short.select("digest", "path").distinct().groupBy("digest").agg(F.count("*").alias("paths")).where(F.col("paths") >= ADDRESSES).select("digest")
    served = short.withColumn("salt", _salt("key")).join(_salted(many), ["digest", "salt"]).select("key", F.lit("addresses").alias("how"))
    return bare.unionByName(whole).unionByName(served)


def judged(documents: DataFrame, key: str, text: str, url: str | None = None) -> DataFrame:
    """(key, how) of the documents to exclude, with what decided; a document may appear with several."""
    pages = cut_lineage(scan(documents, key, text, url))
    slots = pages.where(F.size("slots") > 0).select("key", "digest", F.posexplode("slots").alias("no", "s")).select("key", "digest", "no", "s.*")
    doubtful = pages.where("suspect and content > 0").select(F.explode("templates").alias("template"))
    found = cut_lineage(alignments(documents, key, text, slots, doubtful))
    filled = found.where("not is_sentence").select("key", F.col("h").alias("context"), "v", "digest")
    sentences = found.where("is_sentence").select("key", F.col("h").alias("sentence"), "times", F.col("v").alias("says"), "others", "digest")
    return residual_slots(slots, filled).unionByName(residual_pages(pages, sentences, url is not None))


def residue(documents: DataFrame, key: str, text: str, url: str | None = None) -> DataFrame:
    """(key) of the documents to exclude."""
    return judged(documents, key, text, url).select(F.col("key").alias(key)).distinct()


def without_residue(documents: DataFrame, key: str, text: str, url: str | None = None) -> DataFrame:
    """The documents that remain."""
    return documents.join(residue(documents, key, text, url), key, "left_anti")
