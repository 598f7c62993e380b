"""Personal data: every detected entity gets a keyed surrogate of its own type, format, script and, for names, gender.

Entities are e-mail addresses (in any script), IPv4 and IPv6 addresses, phone (international, North American, and
national with a leading 0), card, social security and IBAN numbers, and names that a title ("Dr. Jones") or a cue
("contact John Smith", "Dear ...") introduces, with their later mentions in the same text. A surrogate is a keyed hash
of the entity's canonical form, dressed in the layout of the mention: digits stay digits, letters letters of the same
case, punctuation stays. Check digits of cards and IBANs are valid where they were, country codes and trunk zeros of
phone numbers stay, social security numbers have areas that exist, private, loopback and link-local addresses stay in
their ranges, and given names are of the same gender and script.

The canonical form decides, so all mentions of an entity, in any layout and in all documents, get one surrogate
(coreference); given name and surname are entities of their own, so "Mr. Smith" follows "John Smith". Distinctness is
checked over the distinct entities of the corpus: where two would share a surrogate, or one would get a real entity's
form, all but the first try again with the next attempt number, which draws from a larger space, until no collision is
left; after MOST_ATTEMPTS the run stops with an error that names the kinds. The first is found by an aggregate, so no
group of equal surrogates is ever gathered.

Texts are read twice. The first time their distinct entities are collected; the second time each text is rewritten where
it is, as surrogates are functions of the entity. Only the entities that had to try again are looked up: in a table of
at most BROADCAST_BYTES sent to every executor, or beyond that by joins, salted as one entity may be in many documents.

Cases: null and empty texts stay as they are; equal texts get equal results, repeated rows stay repeated; an empty
table gives an empty table; all other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import in_arrow, quoted, written

SALTS = 16
#: Bytes of looked-up surrogates that are sent to every executor at most.
BROADCAST_BYTES = 8 << 20
#: Attempts at a distinct surrogate.
MOST_ATTEMPTS = 60
#: Surrogates a task remembers before it starts afresh.
REMEMBERED = 50_000
#: Titles by gender (m, f, or u for either).
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Herrn", "Señor", "Monsieur", "Signor", "Sir", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mademoiselle", "Mme", "Mlle", "Sra", "Signora", "Госпожа", "Κυρία"],
    "u": ["Dr", "Prof", "Professor"],
}
#: Given names by script and gender.
GIVEN = {
    ("LATIN", "m"): ["Adrian", "Bruno", "Conrad", "Dario", "Edgar", "Fabian", "Gustav", "Hector", "Ivan", "Julian", "Kaspar", "Leon", "Marco", "Nestor", "Oscar", "Pablo", "Ruben", "Simon", "Tobias", "Victor"],
    ("LATIN", "f"): ["Alba", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Lucia", "Marta", "Nora", "Olga", "Paula", "Rosa", "Silvia", "Teresa", "Vera"],
    ("CYRILLIC", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим"],
    ("CYRILLIC", "f"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ксения", "Лидия", "Мария"],
    ("GREEK", "m"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"],
    ("GREEK", "f"): ["Άννα", "Βάσω", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
}
#: Syllables of invented names by script.
SYLLABLES = {
    "LATIN": ["ba", "den", "fel", "gor", "har", "kin", "lo", "mar", "nel", "or", "pe", "ran", "sol", "tam", "ver", "win"],
    "CYRILLIC": ["ба", "вол", "гор", "ден", "жар", "зим", "кол", "лов", "мир", "нов", "пет", "рад", "сел", "тур", "фед", "ян"],
    "GREEK": ["βα", "γορ", "δη", "ζα", "θεο", "καλ", "λα", "μαν", "νικ", "ξα", "παπ", "ρα", "στα", "τσι", "φω", "χρι"],
}
#: Words before a full name, and words that are no names though they follow them.
CUES = [
    "contact", "Contact", "Dear", "dear", "Regards", "regards", "Sincerely", "sincerely", "Signed by", "signed by", "name is", "Name", "Attn", "attn", "Attention",
    "Kontakt", "Ansprechpartner", "heiße", "Contacto", "Atentamente", "Cordialement", "Nom", "Nombre",
]
NO_NAMES = frozenset("Customer Service Support Sales Team Office Center Centre Department Sir Madam Information Us Help Desk Hiring Manager Human Resources All Everyone Friend Friends Customers Colleagues".split())
#: First digits of calling codes of one and of two digits; the rest have three.
CALLING_1, CALLING_2 = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Address ranges that an address stays in, with wider ones for later attempts.
RANGES = tuple(map(ipaddress.ip_network, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "fc00::/7", "fe80::/10")))
_TITLE_GENDER = {form: g for g, titles in TITLES.items() for t in titles for form in (t, t.upper())}
_TITLE = "|".join(sorted(_TITLE_GENDER, key=lambda t: (-len(t), t)))
_NAME = r"[A-ZÀ-ÖØ-ÞΆ-ΏΑ-ΫЀ-Я](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
_LOCAL = "._%+-"
_DOMAIN = re.compile(r"[^\W_](?:\w|-)*(?:\.[^\W_](?:\w|-)*)+")
_DIGIT = re.compile(r"[0-9]")
_NUMBERS = re.compile(
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w.-])(?:1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.,/-])0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,4}){0,2}(?![\w-]))"
    r"|(?P<card>(?<!\w)(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|3[47]\d{2}[ -]\d{6}[ -]\d{5})(?!\w))"
)
_COLONS = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
_NAMED = re.compile(rf"(?<!\w)(?:({_TITLE})\.? +({_NAME})(?: +({_NAME}))?|(?:{'|'.join(CUES)})(?:[:,]\s*| +)({_NAME}) +(?:[A-Z]\. +)?({_NAME}))")


def _script(text: str) -> str:
    name = unicodedata.name(next((c for c in text if c.isalpha()), "a"), "LATIN").split(" ")[0]
    return name if name in SYLLABLES else "LATIN"


def _emails(text: str) -> Iterator[tuple[int, int, str, str]]:
    at = text.find("@")
    while at >= 0:
        start = at
        while start and (text[start - 1].isalnum() or text[start - 1] in _LOCAL):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end(), "email", text[start : m.end()].lower()
        at = text.find("@", m.end() if m else at + 1)


def _numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    for m in _NUMBERS.finditer(text):
        kind, raw = m.lastgroup, m[0]
        if kind == "iban":
            canonical = raw.replace(" ", "")
        elif kind == "ip":
            canonical = ".".join(str(int(x)) for x in raw.split("."))
        else:
            canonical = "+" * (kind == "phone" and raw[0] == "+") + re.sub(r"\D", "", raw)
            if kind == "phone" and canonical[0] == "0" and not 9 <= len(canonical) <= 12:
                continue
        yield m.start(), m.end(), kind, canonical
    if text.count(":") > 1:
        for m in _COLONS.finditer(text):
            if _DIGIT.search(m[0]):
                try:
                    yield m.start(), m.end(), "ip6", ipaddress.IPv6Address(m[0]).compressed
                except ValueError:
                    pass


def mentions(text: str | None) -> list[tuple[int, int, str, str]]:
    """(from, until, kind, canonical form) of the entities of a text, in order; kinds of given names end in their gender.

    Of overlapping ones the leftmost counts, then the first of: e-mail address, number, name.
    """
    text = text or ""
    spans: list[tuple[int, int, str, str]] = []
    names: dict[str, str] = {}
    if "@" in text:
        spans += _emails(text)
    if _DIGIT.search(text):
        spans += _numbers(text)
    for m in _NAMED.finditer(text):
        given, surname, gender = (2, 3, _TITLE_GENDER[m[1]]) if m[1] else (4, 5, "u")
        if not m[1] and NO_NAMES & {m[4], m[5]}:
            continue
        for group, part in ((given, "given:" + gender), (surname, "surname")) if m[surname] else ((given, "surname"),):
            spans.append((*m.span(group), part, m[group].casefold()))
            names.setdefault(m[group], part)
    spans.sort(key=lambda x: x[0])
    found: list[tuple[int, int, str, str]] = []
    for x in spans:
        if not found or found[-1][1] <= x[0]:
            found.append(x)
    if names:
        taken = list(found)
        again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=lambda x: (-len(x), x)))) + r")(?!\w)")
        at = 0
        for m in again.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at == len(taken) or taken[at][0] >= m.end():
                found.append((m.start(), m.end(), names[m[0]], m[0].casefold()))
        found.sort()
    return found


class _Draw:
    """A stream of keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canonical: str, attempt: int):
        self._seed, self._round, self._left = (key, f"{kind}\0{canonical}\0{attempt}".encode()), 0, 0

    def below(self, n: int) -> int:
        if self._left < n << 32:
            key, what = self._seed
            self._left = int.from_bytes(hmac.new(key, what + self._round.to_bytes(4, "big"), hashlib.sha256).digest(), "big") | 1 << 256
            self._round += 1
        self._left, out = divmod(self._left, n)
        return out


def _check_digit(digits: str) -> str:
    total = sum(sum(divmod(int(d) * (2 if k % 2 == 0 else 1), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _address(draw: _Draw, canonical: str, attempt: int) -> str:
    own = ipaddress.ip_address(canonical)
    for within in RANGES:
        if own in within:
            if attempt >= 8 and own.version == 4:  # a small range may be used up: private addresses have a larger one
                within = RANGES[0]
            return str(within[1 + draw.below(within.num_addresses - 2)])
    while True:
        out = ipaddress.ip_address(draw.below(2**32 if own.version == 4 else 2**125) + (0 if own.version == 4 else 2**125))  # global unicast: 2000::/3
        if out.is_global and not out.is_multicast or own.version == 6 and not any(out in x for x in RANGES):
            return str(out)


def _phone(draw: _Draw, canonical: str, digit, shape) -> str:
    digits = canonical.lstrip("+")
    if canonical[0] == "+":
        keep = next((n for n, codes in ((1, CALLING_1), (2, CALLING_2)) if digits[:n] in codes), 3)
    else:
        keep = 1 if digits[0] == "0" or digits[0] == "1" and len(digits) == 11 else 0
    rest = digits[keep:]
    if len(rest) == 10 and digits[:keep] in ("", "1"):  # North American: area and exchange start with 2 to 9
        rest = digit(2) + shape(rest[1:3]) + digit(2) + shape(rest[4:])
    else:
        rest = digit(1) * bool(rest) + shape(rest[1:])
    return canonical[: len(canonical) - len(digits)] + digits[:keep] + rest


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The canonical form of an entity's surrogate. Later attempts draw from larger spaces."""
    draw = _Draw(key, kind.split(":")[0], canonical, attempt)
    shape = lambda s: "".join(chr(97 + draw.below(26)) if c.isalpha() else str(draw.below(10)) if c.isdigit() else c for c in s)
    digit = lambda least: str(least + draw.below(10 - least))
    more = "0" * (max(0, attempt - 12) // 4)  # where numbers of this length are used up, longer ones
    if kind == "email":
        local = canonical.partition("@")[0]
        return f"{shape(local)}{draw.below(10**4):04d}@example.{('com', 'net', 'org')[draw.below(3)]}"
    if kind in ("ip", "ip6"):
        return _address(draw, canonical, attempt)
    if kind == "iban":
        account = "".join(chr(65 + draw.below(26)) if c.isalpha() else str(draw.below(10)) for c in canonical[4:] + more)
        right = canonical[2:4] == _iban_check(canonical[:2], canonical[4:])
        check = _iban_check(canonical[:2], account)
        return canonical[:2] + (check if right else f"{(int(check) + 1 + draw.below(90)) % 100:02d}") + account
    if kind == "card":
        own = 2 if len(canonical) == 15 else 1  # the digits that tell the issuer's kind
        body = canonical[:own] + shape(canonical[own:-1] + more)
        last = _check_digit(body)
        return body + (last if canonical[-1] == _check_digit(canonical[:-1]) else str((int(last) + 1 + draw.below(9)) % 10))
    if kind == "ssn":
        area = 1 + draw.below(898)
        return f"{area + (area >= 666):03d}{1 + draw.below(99):02d}{1 + draw.below(9999):04d}" + shape(more)
    if kind == "phone":
        return _phone(draw, canonical + more, digit, shape)
    script = _script(canonical)
    gender = kind.partition(":")[2]
    if gender and attempt < 3:
        gender = gender if gender in "mf" else next((g for (_, g), names in GIVEN.items() if canonical in map(str.casefold, names)), "mf"[draw.below(2)])
        names = GIVEN[script, gender]
        return "-".join(names[draw.below(len(names))].casefold() for _ in range(1 + attempt))
    parts = SYLLABLES[script]
    made = "".join(parts[draw.below(len(parts))] for _ in range(2 + min(attempt, 12) + draw.below(2)))
    return made + {"LATIN": "a", "CYRILLIC": "а", "GREEK": "α"}[script] * (gender == "f")


def dressed(raw: str, kind: str, canonical: str) -> str:
    """The surrogate's canonical form in the layout of a mention; what a longer one has more goes to the end."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(canonical.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in raw) + "".join(digits)
    if kind == "iban":
        chars = iter(canonical)
        return "".join(c if c == " " else next(chars) for c in raw) + "".join(chars)
    if kind in ("email", "ip", "ip6"):
        return canonical.upper() if raw.isupper() and kind != "ip" else canonical
    if raw.isupper() and len(raw) > 1:
        return canonical.upper()
    return "-".join(x[:1].upper() + x[1:] for x in canonical.split("-"))


def replaced(text: str | None, form) -> tuple[str | None, int]:
    """The text with every mention replaced by what form(kind, canonical) gives, and how many there were."""
    found = mentions(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, canonical in found:
        out += [text[at:a], dressed(text[a:b], kind, form(kind, canonical))]
        at = b
    return "".join(out) + text[at:], len(found)


def _found(digests: bool):
    """Texts to their distinct entities (digest of the text if asked for, kind, full kind, canonical form)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                digest = hashlib.md5((text or "").encode()).hexdigest() if digests else None
                fresh = {(digest, kind.split(":")[0], kind, canonical) for _, _, kind, canonical in mentions(text)} - seen
                seen |= fresh
                rows += fresh
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.string()) for k in range(4)], ["digest", "kind", "full", "canonical"])

    return work


def distinct_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, full, canonical, attempt, surrogate of distinct entities (kind, full, canonical): no two of a kind share one, none is an entity."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, full, canonical, attempt = (batch.column(k).to_pylist() for k in range(4))
            made = [surrogate(f, c, a, key) for f, c, a in zip(full, canonical, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "full", "canonical", "attempt", "surrogate"])

    state = entities.select("kind", "full", "canonical", F.lit(0).alias("attempt"))
    real = entities.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
    for _ in range(MOST_ATTEMPTS):
        made = written(in_arrow(state, draw, "kind string, full string, canonical string, attempt int, surrogate string"), "drawn")
        # One row for each surrogate that several entities drew; the first keeps it. All others that drew it lose it.
        shared = made.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canonical")).alias("first")).join(real, ["kind", "surrogate"], "left")
        shared = shared.where("n > 1 or real").select("kind", "surrogate", F.when(F.col("real").isNull(), F.col("first.canonical")).alias("winner"))
        salted = made.withColumn("salt", F.pmod(F.xxhash64("canonical"), F.lit(SALTS)).cast("int"))
        told = salted.join(shared.withColumn("hit", F.lit(True)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["kind", "surrogate", "salt"], "left")
        lost = F.col("hit").isNotNull() & ~F.col("winner").eqNullSafe(F.col("canonical"))
        state = written(told.select("kind", "full", "canonical", (F.col("attempt") + lost.cast("int")).alias("attempt"), "surrogate", lost.alias("lost")), "surrogates")
        if not state.where("lost").head(1):
            return state.drop("lost")
        used = state.where("lost").groupBy("kind").count()
        state = state.select("kind", "full", "canonical", "attempt")
    raise ValueError(f"no distinct surrogates after {MOST_ATTEMPTS} attempts, of {used.collect()}")  # a row a kind


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """docs with every entity of the text column replaced; with count, also a column of that name with how many there were."""
    names, at = docs.columns, docs.columns.index(text)
    narrow = docs.select(F.col(quoted(text)).alias("text")).where("text is not null")
    kinds = "digest string, kind string, full string, canonical string"
    # One gender per given name: the same name after different titles is still one entity.
    entities = in_arrow(narrow, _found(False), kinds).groupBy("kind", "canonical").agg(F.min("full").alias("full"), F.max("full").alias("other"))
    entities = written(entities, "entities")
    made = distinct_surrogates(entities, key)
    several = entities.where("full <> other").select("kind", "canonical", F.lit(True).alias("several"))
    looked_up = made.join(several, ["kind", "canonical"], "left").where("attempt > 0 or several").select("kind", "canonical", "surrogate")
    looked_up = written(looked_up, "looked-up")
    size = looked_up.agg(F.sum(F.octet_length("canonical") + F.octet_length("surrogate") + 16)).head()[0] or 0
    schema = StructType([*docs.schema.fields, *([StructField(count, LongType())] if count else [])])

    def rewritten(columns: list[pa.Array], forms: Iterator[dict], made_here: dict) -> pa.RecordBatch:
        out = []
        for body, own in zip(columns[at].to_pylist(), forms, strict=True):

            def form(kind: str, canonical: str, own: dict = own) -> str:
                told = own.get((kind.split(":")[0], canonical))
                if told is None:
                    told = made_here.get((kind, canonical))
                    if told is None:
                        told = made_here[kind, canonical] = surrogate(kind, canonical, 0, key)
                return told

            out.append(replaced(body, form))
        if len(made_here) > REMEMBERED:
            made_here.clear()
        columns[at] = pa.array([x[0] for x in out], columns[at].type)
        more = [pa.array([x[1] for x in out], pa.int64())] if count else []
        return pa.RecordBatch.from_arrays([*columns, *more], schema.names)

    if size <= BROADCAST_BYTES:
        sent = docs.sparkSession.sparkContext.broadcast({(x["kind"], x["canonical"]): x["surrogate"] for x in looked_up.collect()})

        def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made_here: dict = {}
            for batch in batches:
                yield rewritten(list(batch.columns), iter([sent.value] * batch.num_rows), made_here)

        return in_arrow(docs, replace, schema)
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int").alias("salt")
    salted = in_arrow(narrow, _found(True), kinds).select("digest", "kind", "canonical", salt).distinct()
    forms = salted.join(looked_up.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["kind", "canonical", "salt"])
    forms = forms.groupBy("digest").agg(F.collect_list(F.struct("kind", "canonical", "surrogate")).alias("forms"))  # of one text
    whole = docs.select(F.struct(*(F.col(quoted(c)) for c in names)).alias("row"))
    whole = whole.withColumn("digest", F.md5(F.col("row").getField(text))).join(forms, "digest", "left").select("forms", "row")

    def replace_told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_here: dict = {}
        for batch in batches:
            told = ({(x["kind"], x["canonical"]): x["surrogate"] for x in f or ()} for f in batch.column(0).to_pylist())
            yield rewritten(batch.column(1).flatten(), told, made_here)

    return in_arrow(whole, replace_told, schema)
