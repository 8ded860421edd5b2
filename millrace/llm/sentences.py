"""Sentence boundaries across languages and scripts, by a finite transducer.

The rules are compiled into a transducer that looks both ways. A left automaton reads the characters forward; its state tells which
token (abbreviation, initial, number, plain word) has just been read. A right automaton reads them backward; its state tells how
what follows starts (capital, month, function word, identifier, quote, ...). Together with the marks between the two states, a table of
decisions makes a place a candidate. A third, small automaton tells list items and stamped lines by the first characters of each
line. The last one reads candidates, quotes, brackets and hard breaks, has as its state which quote or bracket is open or that a stamped
line runs, and writes a boundary at hard breaks and at candidates in the open state.

All are run in parallel over chunks: each chunk is a function from states to states (constant for most, as a space
or a comma forgets what was before), the functions are composed by a prefix scan, and with its first state known each chunk is read by itself.
The chunks of all texts of a batch, or of one long text, go through the table together.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread

# Abbreviations by what may follow them.
#: Never the end of a sentence.
NEVER = frozenset(
    """dr prof mr mrs ms st dra sr sra srta mme mlle messrs hr fr rev gen capt lt sgt dipl ing
    nr núm num fig figs abb abs bd kap pp p pág págs pag ch sect eq cf vgl nos eds
    e.g i.e viz vs approx ca env aprox avg bzw ggf evtl inkl exkl sog z.b d.h u.a z.t p.ex p.ej
    табл рис стр гл ул им проф акад напр т.е тыс млн млрд ср гр г-н डॉ श्री श्रीमती د م أ""".split()
)
#: Abbreviations that are plain words as well: the end if a function word follows, which no name or noun is.
PLAIN = frozenset("art tab max min sec ref op ed mag col vol mm см".split())
#: Units among those: after a number they are the end before any capital.
UNITS = frozenset("min sec mm см".split())
#: The end if what follows starts like a sentence.
MAYBE = frozenset("etc usw inc ltd co corp llc plc jr a.m p.m т.д т.п др ecc al и.т.д u.s.w usf gmbh ag s.a".split())
#: German words before an ordinal number, and months after one.
ORDINAL_BEFORE = frozenset("am beim vom zum im ab seit der die das dem den des jeder jede jedes jedem bis nach vor und mit zur".split())
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
#: Function words that start a sentence, but no name.
STARTERS = frozenset(
    """the it he she they we you this that these those there then here when while after before if but and so as what why how where its our
    their his her no not both each some most once since next now also however
    der die das er sie es wir dies diese dieser dieses dann danach dort hier wenn als aber und nach bei im ein eine kein
    le la les un une il elle ils elles on nous vous ce cette ces puis ensuite alors après quand si mais
    el los las ella ellos este esta estos luego después entonces cuando pero en
    он она оно они мы вы это этот эта эти затем потом там здесь когда если но после""".split()
)

_OPEN = "«“„「『\"([{（【《〈"
_CLOSE = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", '"': '"', "(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "〈": "〉"}
_CLOSERS = "»”“\"'’)]}」』）】》〉"
_SYMBOLS = "«»“”„「」『』\"()[]{}（）【】《》〈〉"
_BULLETS = "-*•‣◦▪●"

# Classes of characters: U l o letters with and without case, w letters of scripts without spaces, 9 digits, m marks, s space, n newline,
# E the end of a text; . ! h W D are full stops, other marks, ellipses, wide marks and dandas; O B C quotes and brackets that open, both, close.
_CLASSES = "Ulow9msnE.!hWD_x,#¿OBC'e?"
_TOKEN = frozenset(".Ul9om")
_MARKS = frozenset(".!hWD")
_LETTERS = sorted({ch for w in NEVER | PLAIN | MAYBE | ORDINAL_BEFORE | MONTHS | STARTERS | {"no", "step"} for ch in w if ch not in ".-"})
_WIDE_RANGES = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
END = 0x110000


def _class(ch: str) -> str:
    if ch == "\n":
        return "n"
    if ch.isspace():
        return "s"
    for cls, of in ((".", "."), ("!", "!?؟"), ("h", "…"), ("W", "。！？．｡"), ("D", "।॥۔"), ("_", "_"), ("x", "/@-\\"), (",", ","), ("#", "#|"), ("¿", "¿¡"), ("'", "'’")):
        if ch in of:
            return cls
    if ch in _OPEN:
        return "B" if ch in _CLOSERS else "O"
    if ch in _CLOSERS:
        return "C"
    c = unicodedata.category(ch)
    if any(a <= ord(ch) <= b for a, b in _WIDE_RANGES) and c[0] in "LM":
        return "w"
    if c in ("Lu", "Lt"):
        return "U"
    if c == "Ll":
        return "l"
    return {"L": "o", "N": "9", "M": "m"}.get(c[0], "e" if c == "So" else "?")


def _alphabet() -> tuple[list[tuple[str, str]], dict[tuple[str, str], int]]:
    """Symbols: a class, and the letter itself (in lower case) where a word list has it."""
    known = [(c, "") for c in _CLASSES]
    known += [(c, ch) for ch in _LETTERS for c in ("U", "l", "o", "m") if c in ({_class(ch), "U"} if _class(ch) == "l" else {_class(ch)})]
    return known, {k: i for i, k in enumerate(known)}


SYMBOLS, _SYMBOL_ID = _alphabet()
_ID = {c: _SYMBOL_ID[c, ""] for c in _CLASSES}
_CLASS_OF = np.array([_CLASSES.index(c) for c, _ in SYMBOLS], np.uint8)
_UNKNOWN = 255
_table = np.full(END + 1, _UNKNOWN, np.uint8)
_table[END] = _ID["E"]


def symbols_of(codes: np.ndarray) -> np.ndarray:
    """The symbol of each code point; the table is filled for what occurs."""
    out = _table[codes]
    if (out == _UNKNOWN).any():
        for code in np.unique(codes[out == _UNKNOWN]).tolist():
            ch = chr(code)
            c = _class(ch)
            low = ch.lower()
            _table[code] = _SYMBOL_ID.get((c, low if c in "Ulom" else ""), _ID[c])
        out = _table[codes]
    return out


def _is(sym: np.ndarray, classes: str) -> np.ndarray:
    """Mask of the symbols of some classes."""
    known = np.zeros(len(SYMBOLS), bool)
    known[[i for i, (c, _) in enumerate(SYMBOLS) if c in classes]] = True
    return known[sym]


def prefix_states(functions: np.ndarray, start: int = 0) -> np.ndarray:
    """First state of each chunk: functions composed by doubling, so log2 of the number of chunks rounds."""
    scan = functions.copy()
    d = 1
    while d < len(scan):
        scan[d:] = np.take_along_axis(scan[d:], scan[:-d].copy(), axis=1)
        d *= 2
    return np.r_[start, scan[:-1, start]].astype(np.int64)


class Automaton:
    """A deterministic automaton over SYMBOLS, compiled from a step function on states of any hashable kind."""

    CHUNK, PART, SHORT = 256, 1 << 20, 40

    def __init__(self, start: Hashable, step: Callable[[Hashable, str, str], Hashable], letters: Callable[[Hashable], set[str] | None]):
        """`letters(state)`: the letters that matter in a state; others are stepped by their class."""
        self.states: list = [start]
        known, rows = {start: 0}, []
        for state in self.states:  # grows while it is read
            def to(cls: str, letter: str, state=state) -> int:
                nxt = step(state, cls, letter)
                if nxt not in known:
                    known[nxt] = len(self.states)
                    self.states.append(nxt)
                return known[nxt]

            by_class = {c: to(c, "") for c in _CLASSES}
            own = letters(state)
            rows.append([to(c, ch) if ch and ch in own else by_class[c] for c, ch in SYMBOLS])
        self.step = np.array(rows, np.int64)
        self.n = len(self.states)
        self.flat = (self.step * len(SYMBOLS)).astype(np.int32).ravel()
        self.constant = (self.step == self.step[0]).all(axis=0)
        self.image = {}

    def flags(self, of: Callable[[Hashable], object]) -> np.ndarray:
        return np.array([of(s) for s in self.states])

    def run(self, sym: np.ndarray, chunk: int | None = None) -> np.ndarray:
        """The state behind each symbol."""
        chunk = chunk or self.CHUNK
        out = np.empty(len(sym), np.uint16)
        state, part = 0, max(chunk, self.PART // chunk * chunk)
        for lo in range(0, len(sym), part):
            own = sym[lo : lo + part]
            got = self._run(own, state, min(chunk, len(own)))
            out[lo : lo + part] = got
            state = int(got[-1])
        return out

    def _run(self, sym: np.ndarray, start: int, chunk: int) -> np.ndarray:
        n, rows = len(sym), -(-len(sym) // chunk)
        padded = np.full(rows * chunk, _ID["E"], np.uint8)
        padded[:n] = sym
        grid = np.ascontiguousarray(padded.reshape(rows, chunk).T)
        state = (self._first_states(grid, start) * len(SYMBOLS)).astype(np.int32)
        out = np.empty((chunk, rows), np.int32)
        for t in range(chunk):
            np.take(self.flat, state + grid[t], out=out[t])
            state = out[t]
        return (out.T.reshape(-1)[:n] // len(SYMBOLS)).astype(np.uint16)

    def _first_states(self, grid: np.ndarray, start: int) -> np.ndarray:
        """First state of each chunk. Where a symbol leads to one state from all, the chunk's function is constant."""
        chunk, rows = grid.shape
        if rows == 1:
            return np.array([start], np.int64)
        resets = self.constant[grid]
        has = resets.any(axis=0)
        last = chunk - 1 - np.argmax(resets[::-1], axis=0)
        ends = np.zeros(rows, np.int64)
        for own in (np.flatnonzero(has & (last >= chunk - self.SHORT)), np.flatnonzero(has & (last < chunk - self.SHORT))):
            if len(own):
                at = last[own]
                state = self.step[0, grid[at, own]]
                for t in range(int(at.min()) + 1, chunk):
                    state = np.where(t > at, self.step[state, grid[t, own]], state)
                ends[own] = state
        general = np.flatnonzero(~has)
        # the last chunk's function isn't needed
        functions, varying = self._functions(grid, general[general < rows - 1])
        for r, f in functions.items():
            ends[r] = f[0]
        first = np.r_[start, ends[:-1]]
        if varying:
            run = np.array(varying)
            stack = np.stack([functions[r] for r in varying])
            for i, r in enumerate(varying):
                if r == 0 or r - 1 not in functions or i == 0 or varying[i - 1] != r - 1:
                    stack[i] = stack[i, first[r]]  # what comes before it is known
            first[run + 1] = np.r_[prefix_states(stack)[1:], 0]
            scan_last = stack[-1, first[run[-1]]]
            first[run[-1] + 1] = scan_last
        return first

    def _functions(self, grid: np.ndarray, which: np.ndarray) -> tuple[dict[int, np.ndarray], list[int]]:
        """The functions of chunks without a reset, run for all states that their first symbol leads to; equal states are merged on the way."""
        if not len(which):
            return {}, []
        lanes, row, origin = [], [], []
        for i, r in enumerate(which.tolist()):
            s = int(grid[0, r])
            if s not in self.image:
                self.image[s] = np.unique(self.step[:, s], return_inverse=True)
            image, inverse = self.image[s]
            origin.append((sum(map(len, lanes)) if i == 0 else origin[-1][0] + len(lanes[-1]), inverse))
            lanes.append(image), row.append(np.full(len(image), r))
        state, row = np.concatenate(lanes), np.concatenate(row)
        where = np.arange(len(state))
        for t in range(1, len(grid)):
            state = self.step[state, grid[t, row]]
            if t & (t - 1) == 0:
                key, back = np.unique(row * self.n + state, return_inverse=True)
                state, row, where = key % self.n, key // self.n, back[where]
        final = state[where]
        out = {r: final[at + inverse] for r, (at, inverse) in zip(which.tolist(), origin)}
        return out, [r for r, f in out.items() if (f != f[0]).any()]


class _Trie:
    """Nodes are prefixes; -1 is no prefix of any word."""

    def __init__(self, words: set[str] | frozenset[str]):
        prefixes = sorted({w[:k] for w in words for k in range(len(w) + 1)} | {""})
        self.id = {p: i for i, p in enumerate(prefixes)}
        self.word = prefixes
        self.next: list[set[str]] = [set() for _ in prefixes]
        for p in prefixes:
            if p:
                self.next[self.id[p[:-1]]].add(p[-1])

    def child(self, node: int, ch: str) -> int:
        return self.id.get(self.word[node] + ch, -1) if node >= 0 and ch else -1


@lru_cache(maxsize=1)
def left_automaton() -> tuple[Automaton, dict[str, np.ndarray]]:
    """Reads tokens: letters, digits, marks and inner points. A state is (node of the word so far, kind of a single character, number of
    digits, inner point, whether the last two are letters as before a missing space, initials with points, whether a character of a path or
    address stands before, small letters only, node of the run of letters)."""
    trie, ordinal = _Trie(NEVER | PLAIN | MAYBE | {"no"}), _Trie(ORDINAL_BEFORE | {"step"})
    fresh = (0, "", 0, False, "", 0, False, False, 0)

    def step(state, cls, letter):
        node, single, digits, dot, two, initials, path, lower, letters = state
        if cls not in _TOKEN:
            return (*fresh[:6], cls == "x" or cls == "_", False, 0)
        empty = single == "" and not dot
        if cls == ".":
            if empty:
                return (0, "", 0, True, "", 0, path, True, 0)
            return (trie.child(node, "."), "+", 0, True, "", 2 if initials == 1 else 0, path, lower, 0)
        node, letters = trie.child(node, letter), ordinal.child(letters, letter) if cls in "Ulo" else 0
        if cls == "l":
            two = "ll" if two and two[-1] in "lU" else "l"
        else:
            two = "U" if cls == "U" else ""
        first = single == ""
        digits = (1 if first else min(digits + 1, 3) if digits else 0) if cls == "9" and (first and not dot or digits) else 0
        if cls == "U" and (first and not dot or initials == 2):
            initials = 1
        else:
            initials = 0
        return (node, cls if first and not dot else "+", digits, dot, two, initials, path, (first or lower) and cls != "U", letters)

    made = Automaton(fresh, step, lambda s: (trie.next[s[0]] if s[0] >= 0 else set()) | (ordinal.next[s[8]] if s[8] >= 0 else set()))
    word = lambda s: trie.word[s[0]] if s[0] >= 0 else "?"
    run = lambda s: ordinal.word[s[8]] if s[8] >= 0 else "?"
    flags = {
        "empty": made.flags(lambda s: s[1] == ""), "no": made.flags(lambda s: word(s) == "no"), "never": made.flags(lambda s: word(s) in NEVER),
        "maybe": made.flags(lambda s: word(s) in MAYBE), "plain": made.flags(lambda s: word(s) in PLAIN), "unit": made.flags(lambda s: word(s) in UNITS and s[7]),
        "single": made.flags(lambda s: s[1] in ("U", "l", "o")), "capital": made.flags(lambda s: s[1] == "U"), "short_number": made.flags(lambda s: s[2] in (1, 2)),
        "glue": made.flags(lambda s: s[4] == "ll" and not s[3] and not s[6]), "initials": made.flags(lambda s: s[5] == 1 and s[3]),
        "ordinal": made.flags(lambda s: run(s) in ORDINAL_BEFORE), "step": made.flags(lambda s: run(s) in ORDINAL_BEFORE | {"step"}), "lower": made.flags(lambda s: s[7]),
    }
    return made, flags


@lru_cache(maxsize=1)
def right_automaton() -> tuple[Automaton, dict[str, np.ndarray]]:
    """Reads backward. A state is (space stands first, how what follows starts, form of the word or identifier that starts here, node of the reversed word)."""
    trie = _Trie({w[::-1] for w in MONTHS | STARTERS})
    end = (False, "end", "b", 0)

    def step(state, cls, letter):
        spaced, start, form, node = state
        if cls == "E":
            return end
        if cls in "sn":
            return (True, start, "b", 0)
        if cls in "Ulo":
            # form of a letter: class, digit or underscore behind the letters, runs of small letters joined by points
            word = form[0] in "Ulo"
            joined = form[1] == "1" if word else form == "d"
            runs = (int(form[2]) if form[0] == "l" else 0) if word else 2 if form == "p" else 0 if form == "." else 1
            if cls != "l":
                runs = 0
            node = trie.child(node if word else 0, letter)
            if joined or runs != 1 and cls == "l":
                node = -1
            inner = form[0] == "U" and len(form) > 3  # a capital and a small letter: as in names that start small
            whole = trie.word[node][::-1] if node >= 0 else ""
            if cls == "l":
                start = "i" if joined or runs == 2 or inner else "l"
            elif cls == "o":
                start = "o"
            else:
                more = spaced or form[0] in "Ul"
                start = ("M" if whole in MONTHS else "S" if whole in STARTERS else "U") + ("+" if more else "-")
            kept = f"{cls}{int(joined)}{runs}" + ("+" if cls == "U" and form[0] == "l" else "")
            return (False, start, kept, node)
        if cls == "w":
            return (False, "o", "w", 0)
        if cls == "9":
            return (False, "9", "d", 0)
        if cls == "_":
            return (False, "", "d", 0)
        if cls == ".":
            return (False, "", "p" if form[0] == "l" and form[2] != "0" else ".", 0)
        if cls in "e#":
            return (False, "e", "b", 0)
        if cls == "¿":
            return (False, "U" + ("+" if spaced or form[0] in "Ul" else "-"), "b", 0)
        if cls in "OB":
            # how what is inside starts; a quote that starts small goes on
            return (False, "Q" if start in ("l", "Q") else "q", "b", 0)
        return (False, "", "b", 0)

    made = Automaton(end, step, lambda s: (trie.next[s[3]] if s[3] >= 0 else set()) if s[2][0] in "Ulo" else trie.next[0])
    starts = made.flags(lambda s: s[1])
    flags = {
        "spaced": made.flags(lambda s: s[0]), "end": starts == "end", "capital": np.isin(starts, ["U+", "U-", "M+", "M-", "S+", "S-"]), "more": np.isin(starts, ["U+", "M+", "S+"]),
        "month": np.isin(starts, ["M+", "M-"]), "starter": np.isin(starts, ["S+", "S-"]), "digit": starts == "9", "other": starts == "o", "quote": np.isin(starts, ["q"]),
        "opens": np.isin(starts, ["q", "Q"]), "symbol": starts == "e", "identifier": starts == "i",
    }
    return made, flags


# Transducer: states 0 (open), 1.. (inside a kind of quote or bracket), LOG (inside a stamped line).
_KINDS = list(_OPEN)
LOG = len(_KINDS) + 1
N_STATES = LOG + 1
CAND, HARD, LOG_START, LOG_END = range(4)
_BASE = 4  # then, for each character of _SYMBOLS, one symbol without and one with its closing partner ahead


def _compile() -> tuple[np.ndarray, np.ndarray]:
    n = _BASE + 2 * len(_SYMBOLS)
    step = np.tile(np.arange(N_STATES, dtype=np.uint8)[:, None], (1, n))
    out = np.zeros((N_STATES, n), bool)
    out[0, CAND] = True
    step[:LOG, HARD] = 0
    out[:LOG, HARD] = True
    step[:, LOG_START], out[:, LOG_START] = LOG, True
    step[:, LOG_END], out[:, LOG_END] = 0, True
    for i, c in enumerate(_SYMBOLS):
        for ahead in (0, 1):
            sym = _BASE + 2 * i + ahead
            for k, opener in enumerate(_KINDS, 1):
                if c in _CLOSE[opener]:
                    step[k, sym] = 0
            if ahead and c in _OPEN:
                step[0, sym] = _KINDS.index(c) + 1
    return step, out


STEP, OUT = _compile()
CHUNK = 256


def transduce(symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Positions in `symbols` where a boundary is written."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, HARD, np.int64)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    # each chunk as a function of its first state, all chunks at once
    functions = np.tile(np.arange(N_STATES), (rows, 1))
    for t in range(chunk):
        functions = STEP[functions, grid[t][:, None]]
    state, hit = prefix_states(functions), np.zeros((chunk, rows), bool)
    for t in range(chunk):
        hit[t] = OUT[state, grid[t]]
        state = STEP[state, grid[t]]
    return np.flatnonzero(hit.T.reshape(-1)[:n])


# Lines: (what has been read, how often); "item" and "stamp" are final.
def _line_step(state: tuple[str, int], ch: str, cls: str) -> tuple[str, int]:
    what, n = state
    digit, blank = cls == "9" and ch.isdecimal(), cls == "s"
    if what == "start":
        if blank:
            return state
        if digit:
            return ("digits", 1)
        if ch == "(":
            return ("paren", 0)
        if ch == "[":
            return ("stamp:", 0)
        if ch in _BULLETS:
            return ("marker", 0)
        return ("small", 0) if cls == "l" else ("no", 0)
    if what == "small":
        return ("marker", 0) if ch == ")" else ("no", 0)
    if what == "paren":
        return ("paren digits", 1) if digit else ("no", 0)
    if what == "paren digits":
        if digit:
            return (what, n + 1) if n < 4 else ("no", 0)
        return ("marker", 1) if ch == ")" and n <= 3 else _stamp(("stamp:" + "9" * n), ch, digit)
    if what == "digits":
        if digit:
            return (what, n + 1) if n < 4 else ("no", 0)
        if ch == ")" and n <= 3:
            return ("marker", 1)
        if ch == "." and n <= 3:
            return ("point", n)
        return _stamp("stamp:" + "9" * n, ch, digit)
    if what == "point":  # a number of an item, or a date
        if blank:
            return ("marker blank", 1)
        return _stamp("stamp:99-", ch, digit) if n == 2 else ("no", 0)
    if what == "marker":
        return ("marker blank", n) if blank else ("no", 0)
    if what == "marker blank":
        return state if blank else ("item", n) if cls not in "nE" else ("no", 0)
    if what.startswith("stamp:"):
        return _stamp(what, ch, digit)
    return state


def _stamp(what: str, ch: str, digit: bool) -> tuple[str, int]:
    """Dates with a time, or a time with seconds: 9999-99-99 99:99, 99-99-9999 99:99, 9:99:99."""
    got = what[6:]
    if digit:
        got += "9"
    elif ch == ":":
        got += ":"
    elif ch in "-/." and got.count("-") < 2 and ":" not in got:
        got += "-"
    elif ch in "T ," and got.count("-") == 2:
        got = got.rstrip(" ") + " "
    else:
        return ("no", 0)
    for whole in ("9999-99-99 99:99", "99-99-9999 99:99", "9:99:99", "99:99:99"):
        if got == whole:
            return ("stamp", 0)
    ok = any(whole.startswith(got) for whole in ("9999-99-99 99:99", "99-99-9999 99:99", "9:99:99", "99:99:99"))
    return ("stamp:" + got, 0) if ok else ("no", 0)


@lru_cache(maxsize=1)
def line_automaton() -> tuple[np.ndarray, dict[tuple[str, int], int], dict[str, int]]:
    """(step, states, characters): an automaton over the few characters that matter at the start of a line."""
    chars = {ch: i for i, ch in enumerate(["9", "s", "n", "l", "?", *_BULLETS, *"()[].:/, T"])}
    known, states, rows = {("start", 0): 0}, [("start", 0)], []
    for state in states:
        row = []
        for ch in chars:
            cls = ch if ch in ("9", "s", "n", "l") else "s" if ch == " " else "?"
            nxt = _line_step(state, {"9": "1", "s": "\t", "n": "\n", "l": "a", "?": "%"}.get(ch, ch), cls)
            if nxt not in known:
                known[nxt] = len(states)
                states.append(nxt)
            row.append(known[nxt])
        rows.append(row)
    return np.array(rows), known, chars


def _lines(codes: np.ndarray, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(what, end, value) of each line: 1 an item, 2 an item with a number, 3 a stamp, else 0; where its marker ends; its number. All lines go at once."""
    step, known, chars = line_automaton()
    of_class = {"9": "9", "s": "s", "n": "n", "E": "n", "l": "l"}
    by_symbol = np.array([chars[of_class.get(c, "?")] for c, _ in SYMBOLS])
    item, number, stamp, no = (known.get(k, -1) for k in (("item", 0), ("item", 1), ("stamp", 0), ("no", 0)))
    counting = np.array([k[0] in ("start", "paren", "digits", "paren digits") for k in known])
    marking = np.array([k[0] in ("marker", "point") for k in known])
    what, end, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    alive, at, state = np.arange(len(starts)), starts.astype(np.int64), np.zeros(len(starts), np.int64)
    while len(alive):
        code = codes[at]
        ch = by_symbol[sym[at]]
        for c, i in chars.items():
            if c not in "9snl?":
                ch[code == ord(c)] = i
        digit, number_of = ch == chars["9"], None
        if digit.any():
            number_of = np.full(len(code), -1)
            number_of[digit] = _digits(code[digit])
            ch = np.where(digit & (number_of < 0), chars["?"], ch)
            digit &= number_of >= 0
        before, state = state, step[state, ch]
        if number_of is not None:
            counts = digit & counting[before]
            value[alive] = np.where(counts, np.minimum(value[alive] * 10 + number_of, 10**6), value[alive])
        end[alive] = np.where(marking[state], at + 1, end[alive])
        for s, k in ((item, 1), (number, 2), (stamp, 3)):
            what[alive[state == s]] = k
        on = (state != item) & (state != number) & (state != stamp) & (state != no) & (ch != chars["n"])
        alive, at, state = alive[on], at[on] + 1, state[on]
    return what, end, value


@lru_cache(maxsize=65536)
def _digit_of(code: int) -> int:
    ch = chr(code) if code < END else ""
    return unicodedata.decimal(ch) if ch.isdecimal() else -1


def _digits(code: np.ndarray) -> np.ndarray:
    """The value of each decimal digit, -1 for other characters."""
    out = np.where((code >= 48) & (code <= 57), code.astype(np.int64) - 48, -1)
    for i in np.flatnonzero(code > 127).tolist():
        out[i] = _digit_of(int(code[i]))
    return out


def spans(text: str | None, chunk: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of each sentence, white space at the ends outside; none for a null or blank text."""
    _, start, end = batch_spans([text], chunk)
    return list(zip(start.tolist(), end.tolist()))


def batch_spans(texts: list[str | None], chunk: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the sentences of several texts, read together."""
    length = np.array([len(t) if t else 0 for t in texts], np.int64)
    ends = np.cumsum(length + 1) - 1  # of each text, where an end symbol stands
    base = ends - length
    codes = np.full(int(ends[-1]) + 2 if len(ends) else 1, END, np.uint32)
    raw = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.ones(len(codes), bool)
    inside[ends] = inside[-1] = False
    codes[inside] = raw
    sym = symbols_of(codes)
    left, lf = left_automaton()
    right, rf = right_automaton()
    behind = left.run(sym, chunk)  # the state behind each character
    ahead = right.run(sym[::-1], chunk)[::-1]  # the state in front of it
    space = _is(sym, "snE")

    events: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []  # place, order at one place, symbol, offset of the cut
    newline = np.flatnonzero(sym == _ID["n"])
    starts = np.r_[base[length > 0], newline + 1]
    starts.sort()
    what, marker_end, value = _lines(codes, sym, starts)
    breaks = np.sort(np.r_[newline, ends])
    line_end = breaks[np.searchsorted(breaks, starts)]
    stamped = what == 3
    events.append((starts[stamped], 0, LOG_START, starts[stamped]))
    events.append((line_end[stamped], 0, LOG_END, line_end[stamped]))
    # blank lines: the next character that isn't a space is a newline
    if len(newline):
        first, last = _stretches(_is(sym, "s"))
        nxt = newline + 1
        if len(first):
            k = np.searchsorted(first, nxt)
            at = np.minimum(k, len(first) - 1)
            nxt = np.where((k < len(first)) & (first[at] == nxt), last[at], nxt)
        blank = newline[sym[nxt] == _ID["n"]]
        events.append((blank, 1, HARD, blank))
    items = _items(sym, behind, lf, starts, what, marker_end, value, base, space)
    events.append((starts[items], 2, HARD, starts[items]))
    markers = marker_end[items & (what == 2)] - 1

    cuts = _candidates(codes, sym, behind, ahead, space, lf, rf, markers)
    events.append((cuts, -1, CAND, cuts))
    thai = _thai(codes, sym, marker_end[items])
    events.append((thai, -1, CAND, thai))
    events.append((ends, 3, HARD, ends))

    hard = np.sort(np.concatenate([e[0] for e in events if e[2] != CAND]))
    events += _quotes(codes, sym, hard)
    place = np.concatenate([e[0] for e in events])
    order = np.concatenate([np.full(len(e[0]), e[1]) for e in events])
    symbol = np.concatenate([np.broadcast_to(np.asarray(e[2]), len(e[0])) for e in events])
    offset = np.concatenate([e[3] for e in events])
    by = np.lexsort((symbol, order, place))
    hits = by[transduce(symbol[by], chunk or CHUNK)]
    return _trimmed(np.unique(offset[hits]), base, ends, space)


def _stretches(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each stretch of true values."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    edge = np.r_[0, edge, len(mask)] if len(mask) and mask[0] else np.r_[edge, len(mask)]
    edge = edge if len(edge) % 2 == 0 else edge[:-1]
    return edge[::2], edge[1::2]


def _trimmed(cuts: np.ndarray, base: np.ndarray, ends: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From cuts to spans without white space at the ends, by text."""
    cuts = np.unique(np.r_[0, cuts, ends])
    first, last = _stretches(~space)
    if not len(first):
        return (np.zeros(0, np.int64),) * 3
    lo = np.searchsorted(last, cuts[:-1], side="right")
    start = np.maximum(first[np.minimum(lo, len(first) - 1)], cuts[:-1])
    end = np.minimum(last[np.maximum(np.searchsorted(first, cuts[1:]) - 1, 0)], cuts[1:])
    there = (lo < len(first)) & (start < end)
    start, end = start[there], end[there]
    text = np.searchsorted(ends, start)
    return text, start - base[text], end - base[text]


def _before(space: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The last character before `at` that isn't a space, at most a few spaces back (-1 if there is none so near)."""
    out = at - 1
    for _ in range(8):
        on = (out >= 0) & space[np.maximum(out, 0)]
        if not on.any():
            break
        out = out - on
    return np.where((out >= 0) & ~space[np.maximum(out, 0)], out, -1)


def _items(sym, behind, lf, starts, what, marker_end, value, base, space) -> np.ndarray:
    """Mask of the lines that are list items. A number has to be 1 or to go on counting, and isn't an ordinal broken over a line."""
    items = (what == 1) | (what == 2)
    numbered = np.flatnonzero(what == 2)
    if len(numbered):
        text = np.searchsorted(base, starts[numbered], side="right")
        prior = _before(space, starts[numbered])
        word = (prior >= 0) & lf["step"][behind[np.maximum(prior, 0)]] & (sym[marker_end[numbered] - 1] == _ID["."])
        count, last = {}, -1
        for i, t, k, w, p, s in zip(numbered.tolist(), text.tolist(), value[numbered].tolist(), word.tolist(), prior.tolist(), starts[numbered].tolist()):
            if t != last:
                count, last = 0, t
            if k not in (1, count + 1) or (w and not (sym[p + 1 : s - 1] == _ID["n"]).any()):
                items[i] = False
            else:
                count = k
    return items


def _candidates(codes, sym, behind, ahead, space, lf, rf, markers) -> np.ndarray:
    """Where a sentence ends outside quotes, by the states on both sides of each run of marks: the table of decisions."""
    mark = _is(sym, "".join(_MARKS))
    start, end = _stretches(mark)
    if not len(start):
        return start
    kind = lambda of: np.add.reduceat(_is(sym, of), start) > 0 if len(start) else np.zeros(0, bool)
    # sums up to the next run are those of the run, as no mark lies between
    wide, exclaims = kind("W"), kind("!")
    only = end - start == 1
    # closing quotes and brackets belong to the sentence
    closer = _is(sym, "BC'") & np.isin(codes, [ord(c) for c in _CLOSERS])
    after = end.copy()
    moving = np.arange(len(after))
    while len(moving):
        p = after[moving]
        one = closer[p]
        two = ~one & np.isin(codes[p], (0x20, 0xA0, 0x202F)) & (codes[np.minimum(p + 1, len(codes) - 1)] == ord("»"))
        after[moving] = p + one + 2 * two
        moving = moving[one | two]
    quoted = after > end
    r = ahead[after]
    got = {k: v[r] for k, v in rf.items()}
    lone = np.where(start > 0, behind[start - 1], 0)
    token = {k: v[lone] for k, v in lf.items()}
    spaced, capital, digit = got["spaced"], got["capital"], got["digit"]
    starts = capital | digit | got["symbol"] | got["identifier"] | got["quote"] | (got["other"] & ~quoted)

    # scripts with marks of their own
    own = wide | _is(sym[end - 1], "D")
    in_own = np.where(quoted, (capital | digit | got["quote"]) & (spaced | got["opens"]), True)
    # a space is missing: a word in small letters, a mark and a capital
    glued = ~quoted & only & capital & got["more"] & token["glue"]
    # what a single full stop after a token means
    stop = only & (sym[start] == _ID["."]) & ~quoted
    ends = np.ones(len(start), bool)
    i = np.flatnonzero(stop & spaced & starts & ~own)
    ends[i] = _after_token(sym, behind, space, lf, start[i], {k: v[i] for k, v in token.items()}, {k: v[i] for k, v in got.items()})
    ends &= ~np.isin(start, markers)
    trailing = _is(sym[start], "h") & ~exclaims & ~spaced & got["other"]
    found = ~got["end"] & np.where(own, in_own, ~trailing & starts & np.where(spaced, ends, glued))
    return after[found]


def _after_token(sym, behind, space, lf, start, token, got) -> np.ndarray:
    """Whether a single full stop at `start` ends a sentence, space and a possible start of a sentence following."""
    # the token itself starts behind the last character that belongs to none
    first = _token_start(sym, start)
    prior = _before(space, first)
    there = prior >= 0
    prior_state = behind[np.maximum(prior, 0)]
    prior_word = there & _is(sym[np.maximum(prior, 0)], "Ulo9")
    newline = np.flatnonzero(sym == _ID["n"])
    same_line = np.searchsorted(newline, prior) == np.searchsorted(newline, first)
    out = np.ones(len(start), bool)
    starter, capital = got["starter"], got["capital"]

    out &= ~(token["short_number"] & capital & (got["month"] | (there & lf["ordinal"][prior_state])))
    acronym = token["initials"] & capital & ~starter
    out &= ~acronym
    initial = token["single"]
    out &= ~(initial & ~(token["capital"] & starter & prior_word & same_line & _is(sym[np.maximum(prior, 0)], "lo9")))
    plain = token["plain"]
    number = there & _is(sym[np.maximum(prior, 0)], "9")
    out &= ~(plain & ~(starter | (lf["unit"][behind[np.maximum(start - 1, 0)]] & number & capital)))
    out &= ~token["never"]
    out |= token["maybe"]
    no = token["no"] & got["digit"]
    out[no] = ~(there & _is(sym[np.maximum(prior, 0)], "Ulow9,"))[no]
    out |= token["empty"]
    # abbreviations with spaces inside: "z. B.", "p. m."
    short = np.flatnonzero(token["single"] | (start - first == 2))
    if len(short):
        joined, lower = _spaced_words(sym, first[short], start[short])
        for k, (w, low) in enumerate(zip(joined, lower)):
            if w:
                if w in MAYBE and low:
                    out[short[k]] = True
                elif w in NEVER:
                    out[short[k]] = False
    return out


def _token_start(sym: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the token that ends before `at` starts, at most 40 characters back."""
    out = at.copy()
    alive = np.arange(len(at))
    token = np.zeros(len(SYMBOLS), bool)
    token[[i for i, (c, _) in enumerate(SYMBOLS) if c in _TOKEN]] = True
    for _ in range(40):
        alive = alive[(out[alive] > 0) & token[sym[out[alive] - 1]]]
        if not len(alive):
            break
        out[alive] -= 1
    return out


def _spaced_words(sym: np.ndarray, first: np.ndarray, at: np.ndarray) -> tuple[list[str], list[bool]]:
    """Words of up to three single letters with points and spaces before a short token: ("z.b", small letters only) or ""."""
    out, lower = [], []
    for f, e in zip(first.tolist(), at.tolist()):
        s = [SYMBOLS[k] for k in sym[max(0, f - 10) : e].tolist()]
        parts, i = [], len(s)
        while i > 0 and s[i - 1][0] in "Ulo" and e - f <= 2 or i == len(s):
            j = i
            while j > 0 and s[j - 1][0] in "Ulo":
                j -= 1
            size = i - j
            if size == 0 or size > (2 if not parts else 1):
                parts = []
                break
            parts.insert(0, s[j:i])
            i = j
            if len(parts) == 4:
                break
            k = i - 1 if i and s[i - 1][0] in "sn" else i
            if k > 0 and s[k - 1][0] == ".":
                i = k - 1
                continue
            break
        if len(parts) < 2:
            out.append(""), lower.append(False)
        else:
            out.append(".".join("".join(ch or "?" for _, ch in p) for p in parts)), lower.append(all(c != "U" for p in parts for c, _ in p))
    return out, lower


def _thai(codes: np.ndarray, sym: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Spaces between Thai words that end a sentence."""
    thai = (codes >= 0x0E00) & (codes <= 0x0E7F) & (codes != 0x0E3F)
    if not thai.any():
        return np.zeros(0, np.int64)
    blank = sym == _ID["s"]
    blank &= codes != 0x0D
    start, end = _stretches(blank)
    ok = start > 0
    start, end = start[ok], end[ok]
    left, right = codes[start - 1], codes[end]
    ok = (thai[start - 1] | np.isin(left, [ord(c) for c in "»”\"'’)]}…!?"])) & (thai[end] | np.isin(right, [ord(c) for c in "«“„\"([{"])) & (thai[start - 1] | thai[end])
    return start[ok & ~np.isin(start, items)]


def _quotes(codes: np.ndarray, sym: np.ndarray, hard: np.ndarray) -> list[tuple]:
    """Events of quotes and brackets, each with whether its closing partner stands ahead of the next hard break."""
    at = np.flatnonzero(_is(sym, "OBC"))
    at = at[np.isin(codes[at], [ord(c) for c in _SYMBOLS])]
    if not len(at):
        return []
    code = codes[at]
    limit = hard[np.minimum(np.searchsorted(hard, at, side="right"), len(hard) - 1)]
    out = []
    for i, c in enumerate(_SYMBOLS):
        own = np.flatnonzero(code == ord(c))
        if not len(own):
            continue
        ahead = np.zeros(len(own), np.int64)
        for closer in _CLOSE.get(c, ""):
            later = at[code == ord(closer)]
            if len(later):
                k = np.searchsorted(later, at[own], side="right")
                ahead |= ((k < len(later)) & (later[np.minimum(k, len(later) - 1)] < limit[own])).astype(np.int64)
        # a quote takes effect behind it, so before a candidate at that offset
        out.append((at[own] + 1, -2, _BASE + 2 * i + ahead, at[own] + 1))
    return out


#: Characters that are read together.
TOGETHER = 2_000_000


def _runs(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= TOGETHER:
            yield lo, texts[lo : i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def split_sentences(df: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(`id_col`, start_char, end_char[, sentence]): one row for each sentence of each whole text, in characters from 0.

    Every character that isn't white space at an end lies in exactly one sentence. Blank and null texts have none. Rows
    that repeat an id are split each by itself; an empty table gives an empty result.
    """
    rows = spread(df.select(F.col(id_col), F.col(text).cast("string").alias("text")).filter("text is not null"), id_col)
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in _runs(batch.column(1).to_pylist()):
                at, start, end = batch_spans(texts)
                cols = [batch.column(0).take(pa.array(at + lo)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
                names = [id_col, "start_char", "end_char"]
                if with_text:
                    cols.append(pa.array([texts[i][a:b] for i, a, b in zip(at.tolist(), start.tolist(), end.tolist())], pa.string())), names.append("sentence")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, start_char int, end_char int" + (", sentence string" if with_text else ""))
