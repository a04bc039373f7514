"""Personal data replaced by keyed surrogates.

Detected entities (e-mail, phone, card, IP address, bank account, social security
number, access key, secret, name after a title) get replacements of the same type,
format, script and, for names, gender.  A surrogate is a function of the key and the
entity's canonical form, so an entity has the same surrogate wherever it occurs
(coreference).  First and family names have surrogates of their own, so that "Mr. John
Smith", "Dr Smith" and, later in that text, plain "Smith" agree.

Formatted kinds go through a keyed permutation of all strings of their format (and
class: country code, private or public address, valid check digits) that leaves none in
its place, so unlike entities keep unlike surrogates; names are built from syllables by
a keyed hash.  Over the table of all distinct entities it is then checked that no
surrogate is an entity of the corpus or the surrogate of two.  The few entities that
fail move on to their next surrogate; these exceptions stay a table, which is sent to
all tasks if it is small and joined to the texts that hold such entities if not.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, with_row_key

#: Exceptions that are sent to all tasks at most; more are joined to their texts.
MAX_SENT = 100_000
#: Surrogates that are tried for an entity.  A formatted one that fails so often, in a format whose
#: strings the corpus has nearly used up, keeps its first: another entity's, but no other's surrogate.
ATTEMPTS = 16
SYLLABLES = 3

# Titles by script and gender (m, f, or n where the title does not tell).
TITLES = {
    ("latin", "m"): ["Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Don", "Signor"],
    ("latin", "f"): ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Doña", "Signora"],
    ("latin", "n"): ["Dr", "Prof", "Mx"],
    ("cyrillic", "m"): ["господин", "Господин", "г-н"],
    ("cyrillic", "f"): ["госпожа", "Госпожа", "г-жа"],
    ("greek", "m"): ["κύριος", "Κύριος"],
    ("greek", "f"): ["κυρία", "Κυρία"],
}
# Onsets and vowels of made-up names, and endings by gender of first names and (s) of family names.
SOUNDS = {
    "latin": ("b c d f g h k l m n p r s t v br dr gr kl st".split(), "a e i o u".split(), {"m": "n", "f": "a", "n": "el", "s": "er"}),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split(), {"m": "н", "f": "на", "n": "ль", "ms": "ов", "fs": "ова", "ns": "ко"}),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο".split(), {"m": "ς", "f": "α", "n": "ι", "ms": "ακης", "fs": "ακη", "ns": "ίδη"}),
}
GENDER = {t: (script, g) for (script, g), titles in TITLES.items() for t in titles}

#: Capitals of the scripts in use, accented ones too, and a letter of a name with the mark before it (but for a possessive s).
_CAPITAL = "[" + "".join(c for c in map(chr, [*range(0x590), *range(0x1E00, 0x2000)]) if c.isupper()) + "]"
_NEXT = r"(?:(?:['’](?!s\b)|-)?[^\W\d_])"
_title = "|".join(sorted(map(re.escape, GENDER), key=len, reverse=True))
PATTERN = re.compile(
    r"(?P<email>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<key>\bAKIA[0-9A-Z]{16}\b)"
    r"|(?P<secret>(?<=[=:])(?:(?<=token=)|(?<=token:)|(?<=secret=)|(?<=password=)|(?<=password:))[A-Za-z0-9_/+-]{8,}|(?<=[=:] \")[A-Za-z0-9_/+-]{16,}(?=\")|\b[0-9a-f]{32,}\b)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b)"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<ssn>\b\d{3}-\d{2}-\d{4}\b)"
    r"|(?P<card>(?<![\w+])\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<phone>(?<!\w)\+\d[\d ().-]{6,18}\d(?!\w)|(?<![\w.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w))"
    rf"|(?P<name>\b(?:{_title})\b\.? {_CAPITAL}{_NEXT}+(?: {_CAPITAL}{_NEXT}+\b)?)"
)
#: A text that has none of these holds no entity, and is not searched further.  Each branch of
#: PATTERN has its hint: e-mail @; key, secret and name their words; quoted secret its sign and
#: quote; hex secret its run; IPv6 two colons; international phone plus and digit; all others two digits at most
#: one mark apart.
HINT = re.compile(r"\d[ .-]?\d|\+\d|@|[=:] \"|[0-9a-f]{32}|:[0-9A-Fa-f]*:")
HINT_WORDS = ["AKIA", "token", "secret", "password", *GENDER]
DIGIT_KINDS = ("card", "phone", "ssn")


def entities(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, canonical form, start, end) of each entity in order; of overlapping ones the first.

    A name after a title is one entity for each of its words: the last is the family
    name.  Where a word of it stands alone in the same text, it is found too.  A first
    name after a title of no gender takes the gender that the text gives it elsewhere.
    """
    if not HINT.search(text) and not any(w in text for w in HINT_WORDS):
        return []
    out, names = [], []
    for m in PATTERN.finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        if kind == "name":
            title = m[0].partition(" ")[0].rstrip(".")
            at = start + m[0].index(" ") + 1
            words = text[at:end].split(" ")
            for i, word in enumerate(words):
                names.append((*GENDER[title], i == len(words) - 1, word, at, at + len(word)))
                at += len(word) + 1
            continue
        canon = m[0]
        if kind in DIGIT_KINDS:
            canon = ("+" if m[0].startswith("+") else "") + re.sub(r"\D", "", m[0])
        elif kind == "ip":
            canon = ".".join(str(int(x)) for x in m[0].split("."))
        elif kind == "ip6":
            try:
                canon = ipaddress.IPv6Address(m[0]).exploded
            except ValueError:  # a time, a ratio
                continue
        elif kind == "email":
            canon = m[0].lower()
        out.append((kind, canon, start, end))
    return sorted(out + _names(text, names, out), key=lambda e: e[2]) if names else out


def _names(text: str, names: list[tuple[str, str, bool, str, int, int]], others: list[tuple[str, str, int, int]]) -> list[tuple[str, str, int, int]]:
    gender = {word: g for _, g, last, word, *_ in names if not last and g != "n"}
    known: dict[str, str] = {}
    out = []
    for script, g, last, word, start, end in sorted(names, key=lambda n: n[2]):  # family names count last
        if last:
            form = "s" if script == "latin" else f"{g}s"
        else:
            form = gender.get(word, g)
        known[word] = f"{script}:{form}:{word}"
        out.append(("name", known[word], start, end))
    taken = sorted((start, end) for _, _, start, end in [*others, *out])
    alone = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, known), key=len, reverse=True))})(?!\w|-\w)")
    at = 0
    for start, end in [*taken, (len(text), len(text))]:
        out += [("name", known[m[0]], m.start(), m.end()) for m in alone.finditer(text, at, start) if m.end() <= start]
        at = max(at, end)
    return out


class Surrogates:
    def __init__(self, key: bytes, syllables: int = SYLLABLES):
        self.key, self.syllables = key, syllables

    def _number(self, *parts: object) -> int:
        text = "\x1f".join(map(str, parts)).encode()
        return int.from_bytes(hmac.new(self.key, text, hashlib.sha256).digest(), "big")

    def _walk(self, tweak: str, value: int, size: int, rounds: list[int]) -> int:
        """A keyed permutation of range(size): a Feistel network, its rounds in order or back, walked until it is in range."""
        half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        back = rounds[0] > rounds[-1]
        while True:
            left, right = value >> half, value & mask
            for r in rounds:
                if back:
                    left, right = right ^ (self._number(tweak, r, left) & mask), left
                else:
                    left, right = right, left ^ (self._number(tweak, r, right) & mask)
            value = (left << half) | right
            if value < size:
                return value

    def permute(self, tweak: str, value: int, size: int) -> int:
        """The value after this one in a keyed order of range(size), the first after the last: another one, if there are two."""
        place = (self._walk(tweak, value, size, [0, 1, 2, 3]) + 1) % size
        return self._walk(tweak, place, size, [3, 2, 1, 0])

    def _same_format(self, tweak: str, text: str, alphabets: list[str]) -> str:
        """Each character replaced within its alphabet ('' keeps it), as one permutation of all such strings."""
        value, size = 0, 1
        for c, a in zip(text, alphabets, strict=True):
            if a:
                value, size = value * len(a) + a.index(c), size * len(a)
        value = self.permute(f"{tweak}|{size}", value, size) if size > 1 else value
        out = []
        for c, a in zip(reversed(text), reversed(alphabets), strict=True):
            if a:
                value, at = divmod(value, len(a))
                c = a[at]
            out.append(c)
        return "".join(reversed(out))

    def of(self, kind: str, canon: str, attempt: int = 0) -> str:
        """The surrogate, in canonical form; each attempt goes one step further."""
        if kind == "name":
            return self._name(canon, attempt)
        out = canon
        for _ in range(attempt + 1):
            out = self._step(kind, out)
        return out

    def _step(self, kind: str, canon: str) -> str:
        if kind == "ip":
            n, of = int(ipaddress.IPv4Address(canon)), _network(ipaddress.IPv4Address(canon))
            if of is not None:
                return str(of[self.permute(f"{kind}|{of}", n - int(of[0]), of.num_addresses)])
            while True:  # of the public addresses
                n = self.permute(kind, n, 1 << 32)
                if _network(ipaddress.IPv4Address(n)) is None:
                    return str(ipaddress.IPv4Address(n))
        if kind == "ip6":  # the first 16 bits tell the kind of address
            n, low = int(ipaddress.IPv6Address(canon)), 1 << 112
            return ipaddress.IPv6Address(n // low * low + self.permute(f"{kind}|{n // low}", n % low, low)).exploded
        if kind == "key":
            return self._same_format(kind, canon, [""] * 4 + [DIGITS + UPPER] * (len(canon) - 4))
        if kind == "secret" and re.fullmatch("[0-9a-f]+", canon):
            return self._same_format("hex", canon, ["0123456789abcdef"] * len(canon))
        if kind == "card":
            out = canon
            while True:  # of the numbers of this length, those with the same check status
                out = self._same_format(kind, out, ["" if i == 0 else DIGITS for i in range(len(out))])
                if luhn(out) == luhn(canon):
                    return out
        if kind == "iban":
            # Of an account with right check digits those follow from the rest; others stay wrong.
            right, out = iban_check(canon) == canon[2:4], canon
            while True:
                kept = 4 if right else 2
                out = self._by_class(kind, out, [i < kept for i in range(len(out))])
                check = iban_check(out)
                if right:
                    return out[:2] + check + out[4:]
                if check != out[2:4]:
                    return out
        fixed = [False] * len(canon)
        if kind == "email":
            top = canon.rindex(".")
            fixed = [i >= top for i in range(len(canon))]
        elif kind == "phone" and canon.startswith("+"):
            fixed = [i <= country_digits(canon[1:]) for i in range(len(canon))]
        return self._by_class(kind, canon, fixed)

    def _by_class(self, kind: str, canon: str, fixed: list[bool]) -> str:
        """Digits become digits and letters letters of their case, but for what is ``fixed``."""
        alphabets = ["" if f else next((a for a in (DIGITS, LOWER, UPPER) if c in a), "") for c, f in zip(canon, fixed, strict=True)]
        return self._same_format(kind + "".join(a[:1] or c for a, c in zip(alphabets, canon, strict=True)), canon, alphabets)

    def _name(self, canon: str, attempt: int) -> str:
        script, form, _ = canon.split(":", 2)
        onsets, vowels, endings = SOUNDS[script]
        n, word = self._number("name", canon, attempt), ""
        for _ in range(self.syllables + attempt // 2):  # so that no number of names can use them up
            n, a = divmod(n, len(onsets))
            n, b = divmod(n, len(vowels))
            word += onsets[a] + vowels[b]
        return f"{script}:{form}:{(word + endings[form]).capitalize()}"


LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
UPPER = LOWER.upper()


# Address ranges that are private or otherwise special, and the country codes of two digits (1 and 7 have one, all others three).
SPECIAL = [ipaddress.IPv4Network(x) for x in ("10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4")]
COUNTRIES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _network(address: ipaddress.IPv4Address) -> ipaddress.IPv4Network | None:
    return next((n for n in SPECIAL if address in n), None)


def country_digits(digits: str) -> int:
    return 1 if digits[0] in "17" else 2 if digits[:2] in COUNTRIES else 3


def iban_check(account: str) -> str:
    """The check digits that belong to the country and the rest of an account number."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account[4:] + account[:2] + '00')) % 97:02d}"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def rendered(kind: str, found: str, surrogate: str) -> str:
    """The surrogate in the format of the text that was found."""
    if kind == "name":
        return surrogate.split(":", 2)[2]
    if kind in DIGIT_KINDS:
        digits = iter(re.sub(r"\D", "", surrogate))
        return re.sub(r"\d", lambda _: next(digits), found)
    if kind == "ip6":
        out = surrogate if len(found) == len(surrogate) else ipaddress.IPv6Address(surrogate).compressed
        return out.upper() if found.upper() == found else out
    if kind == "email":
        return "".join(s.upper() if f.isupper() else s for f, s in zip(found, surrogate, strict=True))
    return surrogate


def replace(text: str, surrogates: Surrogates, exceptions: dict[tuple[str, str], str], counts: dict[str, int]) -> str:
    out, at = [], 0
    for kind, canon, start, end in entities(text):
        new = exceptions.get((kind, canon)) or surrogates.of(kind, canon)
        out += [text[at:start], rendered(kind, text[start:end], new)]
        counts[kind] = counts.get(kind, 0) + 1
        at = end
    return "".join([*out, text[at:]]) if out else text


def distinct_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, canon) of all entities of the corpus; each task emits an entity once for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({(k, c) for x in batch.column(0) for k, c, _, _ in entities(x.as_py() or "")})
            columns = [pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "canon"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, canon string").distinct()


def _candidates(rows: DataFrame, surrogates: Surrogates, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogates.of(k, c, attempt) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string())], ["kind", "canon", "new"])

    return rows.select("kind", "canon").mapInArrow(run, "kind string, canon string, new string")


def exceptions(found: DataFrame, surrogates: Surrogates) -> DataFrame:
    """(kind, canon, new) of the entities whose first surrogate is an entity itself or another's surrogate."""
    originals = found.select("kind", F.col("canon").alias("new"))
    first = materialise(_candidates(found, surrogates, 0), "surrogates")
    winners = first.groupBy("kind", "new").agg(F.min("canon").alias("canon")).join(originals, ["kind", "new"], "left_anti")
    failed = materialise(first.join(winners, ["kind", "canon"], "left_anti").select("kind", "canon"), "failed")
    taken = first.select("kind", "new").union(originals)
    out = first.limit(0)
    for attempt in range(1, ATTEMPTS + 1):
        if failed.isEmpty():
            break
        more = materialise(_candidates(failed, surrogates, attempt), "surrogates")
        good = more.groupBy("kind", "new").agg(F.min("canon").alias("canon"))
        good = materialise(good.join(taken, ["kind", "new"], "left_anti").join(out, ["kind", "new"], "left_anti").select("kind", "canon", "new"), "good")
        out = out.union(good)
        failed = materialise(failed.join(good, ["kind", "canon"], "left_anti"), "failed")
    return out


OUT = "text string, n_entities long, kinds map<string,long>"


def _replacer(surrogates: Surrogates, special_of: Callable[[pa.RecordBatch, int], dict[tuple[str, str], str]]):
    """mapInArrow's function over (doc_id, text, ...): the replaced texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, texts, counts = batch.slice(at, 500), [], []
                for i, x in enumerate(part.column(1)):
                    count: dict[str, int] = {}
                    text = x.as_py()
                    texts.append(None if text is None else replace(text, surrogates, special_of(part, i), count))
                    counts.append(count)
                columns = [
                    part.column(0), pa.array(texts, pa.string()), pa.array([sum(c.values()) for c in counts], pa.int64()),
                    pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_entities", "kinds"])

    return run


def _with_special(rows: DataFrame, special: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) with the exceptions that each text needs: an array of (kind, canon, new), null if none."""
    keyed, key = with_row_key(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(0)):
                if found := sorted({(k, c) for k, c, _, _ in entities(text.as_py() or "")}):
                    place = [pa.array([batch.column(n)[i].as_py()] * len(found), pa.int64()) for n in (1, 2)]
                    yield pa.RecordBatch.from_arrays([*place, pa.array([k for k, _ in found]), pa.array([c for _, c in found])], [*key, "kind", "canon"])

    met = keyed.select("text", *key).mapInArrow(run, f"{key[0]} long, {key[1]} long, kind string, canon string")
    needed = met.join(special, ["kind", "canon"]).groupBy(*key).agg(F.collect_list(F.struct("kind", "canon", "new")).alias("special"))
    return keyed.join(needed, key, "left").select("doc_id", "text", "special")


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", max_sent: int = MAX_SENT) -> DataFrame:
    """Every row of ``docs`` with its entities replaced: doc_id, text, n_entities, kinds (map of counts).

    Defined cases: a null text stays null; texts without an entity are returned as they
    are; null and repeated ids give a row each; other columns are ignored; an empty
    table gives an empty result; an empty key is an error.  The key must be kept secret
    and stays the same for corpora that should agree; all entities but the exceptions do.
    """
    if not key:
        raise ValueError("surrogates need a key")
    surrogates = Surrogates(key)
    found = materialise(distinct_entities(docs, text_col), "entities")
    special = exceptions(found, surrogates)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sent = special.limit(max_sent + 1).collect()
    if len(sent) <= max_sent:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["canon"]): r["new"] for r in sent})
        return rows.mapInArrow(_replacer(surrogates, lambda part, i: shared.value), f"doc_id long, {OUT}")
    own = _with_special(rows, materialise(special, "exceptions"))
    return own.mapInArrow(
        _replacer(surrogates, lambda part, i: {(x["kind"], x["canon"]): x["new"] for x in part.column(2)[i].as_py() or []}), f"doc_id long, {OUT}"
    )
