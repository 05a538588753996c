"""Personal data replaced by surrogates: keyed, of the same type and format, distinct and consistent.

What is found is parted into atoms (an address, the digits of a number, a first
name, a surname). An atom's surrogate follows from the key, its kind and itself
alone, so it is the same wherever the atom occurs, in any layout. Numbers, codes
and addresses are permuted among all strings of the same shape, so none of those
share a surrogate; first names change places with others of their gender and
script, and surnames are made of syllables of their script. A check over all
atoms of the corpus finds those whose surrogate another has, or that is itself
somebody's real atom, and tries the next surrogate for them until none is left.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import cut

KEY = b"lattica surrogates"
#: More atoms than these with a second or later surrogate are looked up by a join instead of a dictionary.
MOST_EXCEPTIONS = 100_000

# Forms of address and common first names, by gender.
MALE_TITLES = "Mr Sir Herr Monsieur Señor Don".split()
FEMALE_TITLES = "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Doña".split()
FIRST_NAMES = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kevin Brian George Edward Peter Hans Klaus Jürgen Wolfgang Stefan Pierre Jean Michel Philippe Carlos José Juan Luis Miguel Pedro Antonio Manuel".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Anna Maria Ursula Monika Sabine Petra Claudia Marie Nathalie Isabelle Sophie Camille Carmen Lucía Isabel Pilar Rosa Elena Teresa Laura".split(),
    ("m", "cyrillic"): "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Владимир Павел".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
}
SYLLABLES = {"latin": ("b d f g h k l m n p r s t v w".split(), "a e i o u".split()), "cyrillic": ("б в г д ж з к л м н п р с т".split(), "а е и о у".split())}
NAME_GENDER = {n: (g, s) for (g, s), names in FIRST_NAMES.items() for n in names}



def of_category(*categories: str) -> str:
    """Ranges of all characters of these Unicode categories, as they stand in a regular expression's brackets."""
    at = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) in categories]
    starts = [i for i, before in zip(at, [-2, *at], strict=False) if i != before + 1]
    ends = [i for i, after in zip(at, [*at[1:], -2], strict=True) if i != after - 1]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


UPPER, LOWER, CASELESS, MARK = of_category("Lu", "Lt"), of_category("Ll"), of_category("Lo"), of_category("Mn", "Mc")
#: A capitalised name, of one or two parts, or a run of letters of a script without capitals.
CAPITAL = rf"(?:[{UPPER}][{MARK}]*(?:[{LOWER}][{MARK}]*)+(?:-[{UPPER}][{MARK}]*(?:[{LOWER}][{MARK}]*)+)?|[{CASELESS}][{CASELESS}{MARK}]*)"
NAME = re.compile(rf"(?<![\w]){CAPITAL}(?![\w])")
FOUND = re.compile(
    r"(?<![\w.%+-])(?P<email>[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?<![A-Za-z0-9_-])(?P<key>(?:AKIA[0-9A-Z]{16}|(?:ghp|gho|ghs)_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}))"
    r"|\b(?i:token|password|passwd|pwd|secret|api[_-]?key)\s*[=:]\s*[\"']?(?P<secret>[^\s\"'&]{6,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?<![\d.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)"
    r"|(?<![0-9A-Fa-f:])(?P<ip6>(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4})(?![0-9A-Fa-f:])"
    r"|(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
    r"|(?<!\d)(?P<card>[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3\d{3}[ -]?\d{6}[ -]?\d{5})(?!\d)"
    r"|(?<![\w+])(?P<phone>(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)"
    rf"|\b(?P<title>{'|'.join(MALE_TITLES + FEMALE_TITLES)}|Dr|Prof)\b\.? (?P<person>{CAPITAL}(?: {CAPITAL})?)"
    rf"|\b(?P<first>{'|'.join(NAME_GENDER)}) (?P<last>{CAPITAL})"
)
#: What any of these begins with or holds; a text without is left alone after one quick search.
HINT = re.compile(rf"[@:=]|\d{{3}}|\d\.\d|\+\d|[A-Z]{{2}}\d{{2}}|AKIA|\b(?:{'|'.join(MALE_TITLES + FEMALE_TITLES)}|Dr|Prof|{'|'.join(NAME_GENDER)})\b|sk-|gh[pos]_|eyJ")
ACCENTED, CYRILLIC = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
COMMON_SETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ACCENTED, ACCENTED.upper(), CYRILLIC, CYRILLIC.upper()]
#: After so many surrogates of its shape that were taken, an address, key, secret or surname gets one of another shape.
MOST_SHAPED = 16
#: No corpus needs so many attempts; to need more is an error, not a loop without end.
MOST_ATTEMPTS = 64
#: Strings of more characters are replaced by a keyed stream instead of a permutation, in time that grows with their length.
LONG = 64
# Calling codes of one and two digits; all others have three.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
DIGIT_KINDS = frozenset(("ssn", "card", "phone"))


def keyed(key: bytes, *parts) -> int:
    named = "\0".join(f"{x:x}" if isinstance(x, int) else x for x in parts)
    return int.from_bytes(hashlib.blake2b(named.encode("utf-8", "surrogatepass"), key=key, digest_size=8).digest(), "big")


def permuted(x: int, n: int, key: bytes, *tweak) -> int:
    """The place of x under a keyed permutation of 0..n-1: a Feistel network, walked until it falls below n."""
    if n < 2:
        return x
    half = ((n - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    stretch = -(-half // 64)
    while True:
        left, right = x >> half, x & mask
        for i in range(6):
            f = 0
            for j in range(stretch):
                f = f << 64 | keyed(key, *tweak, i, j, right)
            left, right = right, left ^ f & mask
        x = left << half | right
        if x < n:
            return x


def kin(c: str) -> tuple:
    """What a letter or digit shares with those that can take its place: category, script, and whether it survives a change of case."""
    other = c.swapcase()
    return unicodedata.category(c), unicodedata.name(c, "").split(" ")[0].split("-")[0], len(other) == 1 and other.swapcase() == c


@lru_cache(1 << 14)
def alphabet(c: str) -> str | None:
    """The characters among which c is permuted: a common set, or those like it among the 256 around it; none for marks and signs."""
    if common := next((a for a in COMMON_SETS if c in a), None):
        return common
    if not c.isalnum():
        return None
    start = ord(c) & ~255
    near = [d for d in map(chr, range(start, start + 256)) if kin(d)[:2] == kin(c)[:2] and not any(d in a for a in COMMON_SETS)]
    same = [d for d in near if kin(d) == kin(c)]
    return "".join(same if len(same) > 1 else near)


def shapes(s: str) -> int:
    """How many strings have the shape of s (of its first LONG characters, if it is longer)."""
    n = 1
    for c in s[:LONG]:
        n *= len(alphabet(c) or "-")
    return n


def fresh(s: str, key: bytes, *tweak) -> str:
    """A keyed string of small letters and digits, at least as long as s."""
    x, out = 0, []
    for i in range(max(len(s), 10)):
        x = x if i % 10 else keyed(key, s, "fresh", i, *tweak)
        x, r = divmod(x, 36)
        out.append("abcdefghijklmnopqrstuvwxyz0123456789"[r])
    return "".join(out)


def reshaped(s: str, key: bytes, *tweak) -> str:
    """Another string of the same shape: digits for digits, letters for letters of their case and script, hexadecimal as such; the rest stays."""
    hexa = re.fullmatch(r"[0-9a-f]+", s) and re.search(r"[a-f]", s) and re.search(r"\d", s) and len(s) >= 12
    own = ["0123456789abcdef"] * len(s) if hexa else [alphabet(c) for c in s]
    if len(s) > LONG:  # a keyed stream; its chance of a repeat is none to speak of, and it would be found like any other
        named = "\0".join((s, *map(str, tweak))).encode("utf-8", "surrogatepass")
        stream = hashlib.shake_256(hashlib.blake2b(named, key=key).digest()).digest(2 * len(s))
        return "".join(a[(stream[2 * i] << 8 | stream[2 * i + 1]) % len(a)] if a else c for i, (c, a) in enumerate(zip(s, own, strict=True)))
    x, n = 0, 1
    for c, a in zip(s, own, strict=True):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    shape = "".join(a[0] if a else c for c, a in zip(s, own, strict=True))
    x, out = permuted(x, n, key, shape, *tweak), []
    for c, a in zip(reversed(s), reversed(own), strict=True):
        if a:
            x, r = divmod(x, len(a))
            c = a[r]
        out.append(c)
    return "".join(reversed(out))


@lru_cache(256)
def next_name(names: tuple[str, ...], key: bytes, attempt: int) -> dict[str, str]:
    """Each name and the one behind it in a keyed circle, so none stands for itself and no two share one."""
    order = sorted(names, key=lambda n: keyed(key, "first", attempt, n))
    return dict(zip(order, [*order[1:], order[0]], strict=True))


def luhn(digits: str) -> int:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10


def script(s: str) -> str:
    if re.search("[А-Яа-яЁё]", s):
        return "cyrillic"
    names = {unicodedata.name(c, "").split(" ")[0] for c in s if c.isalpha()}
    return "latin" if names <= {"LATIN"} else "other"


def surrogate(kind: str, atom: str, attempt: int, key: bytes = KEY) -> str:
    """The surrogate of an atom in its normal form."""
    t = (kind, attempt)
    late = attempt >= MOST_SHAPED
    if kind == "card":
        if luhn(atom) == 0:
            body = atom[0] + reshaped(atom[1:-1], key, *t)
            return body + str(-luhn(f"{body}0") % 10)
        return atom[0] + reshaped(atom[1:], key, *t)
    if kind == "phone":
        keep = atom.index(" ") + 1 if " " in atom else 0
        return atom[:keep] + reshaped(atom[keep:], key, *t)
    if kind == "ip":
        a, b, c, d = map(int, atom.split("."))
        x = permuted((a << 24) + (b << 16) + (c << 8) + d, 1 << 32, key, *t)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "key" and (m := re.match(r"AKIA|gh[pos]_|sk-|eyJ", atom)):
        rest = atom[m.end() :]
        return m[0] + (fresh if late or shapes(rest) < 2 else reshaped)(rest, key, *t)
    if kind == "iban":
        return atom[:2] + reshaped(atom[2:], key, *t)
    if kind == "email":
        local, _, host = atom.partition("@")
        name, dot, top = host.rpartition(".")
        return f"{(fresh if late or shapes(local) < 2 else reshaped)(local, key, *t)}@{reshaped(name, key, *t)}{dot}{top}"
    if kind == "first":
        return next_name(tuple(FIRST_NAMES[NAME_GENDER[atom]]), key, attempt)[atom]
    if kind == "surname" and script(atom) == "other" and not late and shapes(atom) > 1:
        return reshaped(atom, key, *t)
    if kind == "surname":
        x, (cons, vowels) = keyed(key, atom, *t), SYLLABLES["cyrillic" if script(atom) == "cyrillic" else "latin"]
        parts = []
        for part in atom.split("-"):  # as many parts, each of about the length it had
            out = []
            for i in range(max(3, min(12, len(part) // 2)) + (3 if late else 0)):
                x = x if x else keyed(key, atom, "more", i, *t)
                x, c = divmod(x, len(cons))
                x, v = divmod(x, len(vowels))
                out.append(cons[c] + vowels[v])
            if len(part) % 2 and len(part) > 6:
                out.append(cons[x % len(cons)])
            parts.append("".join(out).capitalize())
        return "-".join(parts)
    if kind == "secret" and (late or shapes(atom) < 2):
        return fresh(atom, key, *t)
    return reshaped(atom, key, *t)


def atoms_of(m: re.Match) -> list[tuple[str, str, int, int]]:
    """(kind, atom in normal form, start, end) of what a match holds."""
    kind = m.lastgroup if m.lastgroup not in ("person", "last") else "name"
    if kind != "name":
        a, b = m.span(kind)
        s = m[kind]
        if kind in ("ssn", "card"):
            s = re.sub(r"\D", "", s)
        elif kind == "phone":
            digits = re.sub(r"\D", "", s)
            if s[0] == "+":  # its calling code and the rest, in whatever layout
                code = next((n for n in (1, 2) if digits[:n] in SHORT_CODES), 3)
                digits = f"+{digits[:code]} {digits[code:]}"
            s = digits
        elif kind == "iban":
            s = s.replace(" ", "")
        elif kind in ("email", "ip6"):
            s = s.lower()
        elif kind == "secret" and re.fullmatch(r"[\W_]+", s):
            return []
        return [(kind, s, a, b)]
    group = "first" if m["first"] else "person"
    if group == "first":
        return [("first", m["first"], *m.span("first")), ("surname", m["last"], *m.span("last"))]
    out, at = [], m.start("person")
    for i, w in enumerate(m["person"].split(" ")):
        known = i == 0 and w in NAME_GENDER and " " in m["person"]
        out.append(("first" if known else "surname", w, at, at + len(w)))
        at += len(w) + 1
    return out


def found_in(text: str | None) -> list[tuple[str, str, int, int]]:
    """All atoms of a text in order; names that stand with a title or a first name once are found where they stand alone as well."""
    if not text or not HINT.search(text):
        return []
    found = [a for m in FOUND.finditer(text) for a in atoms_of(m)]
    names = {s: kind for kind, s, _, _ in found if kind in ("surname", "first")}
    if not names:
        return found
    taken, at, alone = [(a, b) for _, _, a, b in found], 0, []
    for m in NAME.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if m[0] in names and (at == len(taken) or m.end() <= taken[at][0]):
            alone.append((names[m[0]], m[0], m.start(), m.end()))
    return sorted(found + alone, key=lambda a: a[2]) if alone else found


def laid_out(kind: str, seen: str, new: str) -> str:
    """The surrogate in the layout in which its atom was seen."""
    if kind in DIGIT_KINDS or kind == "iban":
        rest = iter(re.sub(r"[^\dA-Z]", "", new))
        return "".join(next(rest, "") if re.match(r"[\dA-Z]", c) else c for c in seen)
    return new.upper() if kind in ("email", "ip6") and seen.isupper() else new


def replaced(text: str | None, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> tuple[str | None, list[str]]:
    """The text with surrogates, and the kinds of the atoms replaced in order."""
    out, at, kinds = [], 0, []
    for kind, atom, a, b in found_in(text):
        out += [text[at:a], laid_out(kind, text[a:b], surrogate(kind, atom, attempts.get((kind, atom), 0), key))]
        at = b
        kinds.append(kind)
    return ("".join([*out, text[at:]]) if kinds else text), kinds


def _atom_batches(batches):
    for b in batches:
        rows = sorted({(k, a) for t in b.column(0).to_pylist() for k, a, _, _ in found_in(t)})
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["kind", "atom"])


def _surrogate_batches(key: bytes):
    def run(batches):
        for b in batches:
            made = [surrogate(k, a, n, key) for k, a, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], ["kind", "atom", "attempt", "surrogate"])

    return run


def attempts(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, atom, attempt, surrogate) of every atom of the corpus, so that surrogates of a kind are distinct and nobody's real atom.

    Of the 40 or so first names of a gender all may be real, so only their
    distinctness counts (which the permutation gives).
    """
    atoms = docs.select("text").mapInArrow(_atom_batches, "kind string, atom string").distinct()
    rounds = 0
    table = cut(atoms.withColumn("attempt", F.lit(0)).mapInArrow(_surrogate_batches(key), "kind string, atom string, attempt int, surrogate string"))
    while True:
        first = table.groupBy("kind", "surrogate").agg(F.min("atom").alias("atom"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        twice = table.alias("t").join(first.alias("f"), ["kind", "surrogate"]).filter("t.atom <> f.atom").select("kind", "t.atom")
        real = table.select("kind", F.col("atom").alias("surrogate"))
        taken = table.filter("kind <> 'first'").join(real, ["kind", "surrogate"], "left_semi").select("kind", "atom")
        clash = cut(twice.unionByName(taken).distinct())
        if not clash.head(1):
            return table
        if (rounds := rounds + 1) > MOST_ATTEMPTS:
            raise RuntimeError(f"after {MOST_ATTEMPTS} attempts some surrogates are still taken")
        again = table.join(clash.withColumn("again", F.lit(1)), ["kind", "atom"], "left").select("kind", "atom", (F.col("attempt") + F.coalesce("again", F.lit(0))).cast("int").alias("attempt"))
        table = cut(again.mapInArrow(_surrogate_batches(key), "kind string, atom string, attempt int, surrogate string"))


def surrogates(docs: DataFrame, key: bytes = KEY, most_exceptions: int = MOST_EXCEPTIONS, kinds: str | None = "pii_kinds") -> DataFrame:
    """docs with the text replaced by one with surrogates, and a column ``kinds`` of what was replaced (none if that is None).

    A null text stays null; texts without personal data stay as they are. Other
    columns, null ids and repeated rows are kept; where docs have a column of that
    name, theirs stays and the new one has ``_1`` (or the next free number) behind
    its name. Texts and secrets of any length are read and replaced whole, in time
    that grows with their length.
    """
    if kinds:
        kinds = next(n for n in (kinds, *(f"{kinds}_{i}" for i in range(1, len(docs.columns) + 2))) if n not in docs.columns)
    later = attempts(docs, key).filter("attempt > 0").select("kind", "atom", "attempt")
    few = later.limit(most_exceptions + 1).collect()
    name, row = "__pii_row", "__pii_id"
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name)
    if len(few) <= most_exceptions:
        fixed = {(r["kind"], r["atom"]): r["attempt"] for r in few}
        rows = docs.select(F.col("text").alias("__pii_text"), F.lit(None).cast("array<string>").alias("own"), whole)
    else:
        fixed = {}
        numbered = docs.withColumn(row, F.monotonically_increasing_id())

        def seen(batches):
            for b in batches:
                got = [(i, k, a) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, a in {(k, a) for k, a, _, _ in found_in(t)}]
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[i] for g in got], pa.string()) for i in (1, 2))], [row, "kind", "atom"])

        uses = numbered.select(row, "text").mapInArrow(seen, f"{row} long, kind string, atom string").join(later, ["kind", "atom"])
        own = uses.groupBy(row).agg(F.collect_list(F.concat_ws("\0", "kind", "atom", "attempt")).alias("own"))
        rows = numbered.join(own, row, "left").select(F.col("text").alias("__pii_text"), "own", whole)
    schema = rows.schema

    def run(batches):
        for b in batches:
            got = []
            for t, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                more = {tuple(x.split("\0")[:2]): int(x.split("\0")[2]) for x in own or ()}
                got.append(replaced(t, fixed | more if more else fixed, key))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string())), b.column(2)], ["__pii_text", "own", name])

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col("__pii_text").alias(c) if c == "text" else F.col(f"{name}.`{c}`").alias(c) for c in docs.columns], *[F.col("own").alias(k) for k in (kinds,) if k])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return surrogates(docs)
