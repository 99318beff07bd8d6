"""Personal data replaced by keyed surrogates of the same kind.

``detect`` finds entities in a text. An entity's surrogate is drawn from an HMAC of its
normal form under a secret key, so one value has one surrogate wherever it stands, and
nothing is kept to remember it. Names are found behind a title, or as listed given names
with a family name behind them, and then wherever they stand again in the same text as whole
words; other names are not found. A surrogate has the form of what it stands for: letters,
digits and separators stay where they are, card numbers and IBANs keep valid check digits
if they had them, names keep gender, script and case.

Two values could draw one surrogate, or a surrogate could be a value that occurs. The
distinct values of the corpus are compared as a table: of those that clash, all but the
least draw again, until none clashes. Only values that drew again travel to the texts.

Defined cases: a null text stays null and an empty one empty; repeated rows are replaced
alike; an empty table gives an empty table; all columns of the input are kept as they are,
but for one named ``n_entities``, which the result replaces.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from meterlens.llm.common import fresh, small_side
from meterlens.session import settle

# Given names by script and gender, family names by script, titles by gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Beatrice Carla Clara Diana Elena Emma Eva Frida Greta Hanna Helen Ida "
                    "Ines Julia Karin Laura Lena Lucia Maria Marta Nina Nora Olga Paula Rosa Sara Sofia "
                    "Teresa Ursula Vera".split(),
    ("latin", "m"): "Adam Albert Anton Bruno Carlos Daniel David Emil Erik Felix Frank Georg Hugo Ivan "
                    "Jakob John Jonas Karl Leo Lukas Marco Martin Max Oscar Otto Paul Peter Robert "
                    "Simon Thomas Victor Walter".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Софья".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Дмитрий Иван Максим Николай Олег Павел Сергей".split(),
}
FAMILY = {
    "latin": "Albers Bauer Bennett Berger Castillo Dubois Ellis Fischer Fontaine Garnier Hansen Harper "
             "Herrera Hoffman Jensen Keller Lambert Lopez Marshall Meyer Morel Moreno Navarro Parker "
             "Reyes Roth Santos Schulz Turner Vidal Weber Winter".split(),
    "cyrillic": "Белов Волков Громов Зайцев Козлов Лебедев Морозов Орлов Соколов Фомин".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra Señorita Srta Госпожа".split(),
    "m": "Mr Mister Herr Monsieur Señor Sr Господин".split(),
    "": "Dr Prof".split(),
}
GENDER_OF_TITLE = {t: g for g, titles in TITLES.items() for t in titles}
GENDER_OF_NAME = {n: g for (_, g), names in GIVEN.items() for n in names}

NAME = r"[A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-я]+(?:-[A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-я]+)?"
PATTERNS: list[tuple[str, str, re.Pattern]] = [  # kind, character that must occur, pattern
    ("email", "@", re.compile(
        r"(?<![\w.%+-])[\w.%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+", re.ASCII)),
    ("secret", "AKIA", re.compile(r"\bAKIA[0-9A-Z]{16}\b", re.ASCII)),
    ("secret", "", re.compile(
        r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key))\s?[=:]\s?[\"']?"
        r"(?P<value>[^\s\"',;]{6,})", re.ASCII)),
    ("iban", "0", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII)),
    ("phone", "0", re.compile(
        r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
        r"|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[-.][0-9]{4}(?![0-9])"
        r"|(?<![\w.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![\w.-]?[0-9])", re.ASCII)),
    ("card", "0", re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])", re.ASCII)),
    ("ssn", "0", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.ASCII)),
    ("ip", "0", re.compile(
        r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}"
        r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\w|\.[0-9])", re.ASCII)),
]
DIGIT = re.compile("[0-9]")
TITLED = re.compile(
    r"\b(?P<title>" + "|".join(sorted(GENDER_OF_TITLE, key=len, reverse=True)) + r")\b\.? "
    rf"(?P<names>{NAME}(?: {NAME}){{0,2}})"
)
GIVEN_NAME = "(?:" + "|".join(sorted(GENDER_OF_NAME, key=len, reverse=True)) + ")"
UNTITLED = re.compile(rf"(?<![\w-])(?P<names>{GIVEN_NAME}(?: {GIVEN_NAME})* {NAME})(?!\w)")
MENTION = re.compile(rf"(?<!\w){NAME}(?!\w)")


def luhn(digits: str) -> bool:
    """Whether a number ends in its right check digit."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _script(name: str) -> str:
    return "cyrillic" if "А" <= name[0] <= "я" else "latin"


def _names(match: re.Match) -> Iterator[tuple[int, int, str, str]]:
    """Given and family names of a titled or untitled name, as entities of their own."""
    parts = [(m.start(), m[0]) for m in re.finditer(r"\S+", match["names"])]
    gender = GENDER_OF_TITLE[match["title"]] if "title" in match.re.groupindex else ""
    for k, (at, name) in enumerate(parts):
        family = k == len(parts) - 1
        own = gender or GENDER_OF_NAME.get(parts[0][1], "")
        kind = f"family/{_script(name)}" if family else f"given/{_script(name)}/{own or 'm'}"
        begin = match.start("names") + at
        yield begin, begin + len(name), kind, name


def _mentions(text: str, named: list[tuple[int, int, str, str]]) -> Iterator[tuple[int, int, str, str]]:
    """All whole words that are one of the names found in the text, of the kind found first."""
    kinds: dict[str, str] = {}
    for _, _, kind, name in sorted(named, key=lambda s: s[0]):
        kinds.setdefault(name, kind)
    for match in MENTION.finditer(text):
        at = match.start()
        for name in [match[0]] if match[0] in kinds else match[0].split("-"):
            if name in kinds:
                yield at, at + len(name), kinds[name], name
            at += len(name) + 1


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities in a text, in order, none overlapping."""
    if not text:
        return []
    spans: list[tuple[int, int, str, str]] = []
    digits = DIGIT.search(text) is not None
    for kind, needs, pattern in PATTERNS:
        if needs == "0" and not digits or needs not in ("", "0") and needs not in text:
            continue
        for match in pattern.finditer(text):
            group = "value" if "value" in pattern.groupindex else 0
            value = match[group]
            bare = re.sub("[ -]", "", value)
            if kind == "card" and not luhn(bare) or kind == "iban" and not iban_valid(bare):
                continue
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in value) <= 15:
                continue
            spans.append((match.start(group), match.end(group), kind, value))
    named = [n for pattern in (TITLED, UNTITLED) for match in pattern.finditer(text) for n in _names(match)]
    if named:
        spans += named
        spans += _mentions(text, named)
    kept: list[tuple[int, int, str, str]] = []
    for span in sorted(spans, key=lambda s: s[0]):  # of one start, the pattern named first
        if not kept or span[0] >= kept[-1][1]:
            kept.append(span)
    return kept


def normal_form(kind: str, value: str) -> str:
    """What two mentions of one entity share."""
    if kind == "email":
        return value.lower()
    if kind in ("card", "iban", "phone", "ssn"):
        return re.sub(r"[^0-9A-Za-z+]", "", value)
    return value


def _stream(key: bytes, kind: str, value: str, attempt: int) -> Callable[[int], int]:
    """Draws below a bound, fixed by key, kind, value and attempt."""
    state = {"block": b"", "n": 0}
    seed = f"{kind}\0{value}\0{attempt}".encode()

    def draw(below: int) -> int:
        if len(state["block"]) < 4:
            message = seed + state["n"].to_bytes(4, "big")
            state["block"] += hmac.new(key, message, hashlib.sha256).digest()
            state["n"] += 1
        number, state["block"] = int.from_bytes(state["block"][:4], "big"), state["block"][4:]
        return number % below

    return draw


def _alike(value: str, draw: Callable[[int], int]) -> str:
    """Another text of the same form: digits, hex digits and letters stay such."""
    hexed = re.fullmatch("(?=[0-9]*[a-f])[0-9a-f]{8,}", value) is not None
    out = []
    for c in value:
        if hexed:
            out.append("0123456789abcdef"[draw(16)])
        elif "0" <= c <= "9":
            out.append("0123456789"[draw(10)])
        elif "a" <= c <= "z":
            out.append("abcdefghijklmnopqrstuvwxyz"[draw(26)])
        elif "A" <= c <= "Z":
            out.append("ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw(26)])
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The surrogate of a value in its normal form, at the given draw.

    From the eighth draw on, forms with few values may change their length.
    """
    draw = _stream(key, kind, value, attempt)
    wider = max(0, attempt - 7)
    if kind == "email":
        local, _, domain = value.partition("@")
        labels = domain.split(".")
        return f"{_alike(local + 'x' * wider, draw)}@" + ".".join(
            [_alike(label, draw) for label in labels[:-1]] + labels[-1:]
        )
    if kind == "card":
        body = value[0] + _alike(value[1:-1] + "0" * (2 * wider), draw)
        return next(body + d for d in "0123456789" if luhn(body + d))
    if kind == "iban":
        body = _alike(value[4:] + "0" * wider, draw)
        check = 98 - int("".join(str(int(c, 36)) for c in body + value[:2]) + "00") % 97
        return f"{value[:2]}{check:02d}{body}"
    if kind == "phone":
        lead = 2 if value.startswith("+") else 0  # the country stays
        return value[:lead] + _alike(value[lead:] + "0" * wider, draw)
    if kind == "ip":
        ranges = {1: (1, 9), 2: (10, 90), 3: (100, 156)}
        octets = [(1, 254) if wider else ranges[len(o)] for o in value.split(".")]
        return ".".join(str(low + draw(n)) for low, n in octets)
    if kind.startswith(("given", "family")):
        what, script, *gender = kind.split("/")
        names = GIVEN[script, gender[0]] if what == "given" else FAMILY[script]
        drawn = [names[draw(len(names))] for _ in range(1 + attempt // 4)]
        return "-".join(dict.fromkeys(drawn)) + ("" if attempt < 24 else f"-{names[0]}{'a' * (attempt - 23)}")
    lead = 4 if value.startswith("AKIA") else 0  # the mark of an access key stays
    return value[:lead] + _alike(value[lead:] + "0" * wider, draw)


def in_form_of(shown: str, kind: str, new: str) -> str:
    """A surrogate with the separators and case that the value had in the text."""
    if kind in ("card", "iban", "phone", "ssn"):
        rest = iter(new)
        out = [next(rest, "") if re.match("[0-9A-Za-z+]", c) else c for c in shown]
        return "".join(out) + "".join(rest)
    if kind == "email" and shown.isupper():
        return new.upper()
    return new


def replace(
    text: str | None, key: bytes, attempts: dict[str, int] | None = None
) -> tuple[str | None, int, list[tuple[int, int, str]]]:
    """Text with surrogates, how many, and where they now stand (start, end, kind)."""
    found = detect(text)
    if not found:
        return text, 0, []
    out, at, size, spans = [], 0, 0, []
    for begin, end, kind, shown in found:
        value = normal_form(kind, shown)
        attempt = (attempts or {}).get(f"{kind}\0{value}", 0)
        new = in_form_of(shown, kind, surrogate(key, kind, value, attempt))
        out += [text[at:begin], new]
        size += begin - at
        spans.append((size, size + len(new), kind))
        size += len(new)
        at = end
    return "".join(out) + text[at:], len(found), spans


def _entities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct entities of each document."""
    for batch in batches:
        rows, names = [], []
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
            for name in {f"{k}\0{normal_form(k, v)}" for _, _, k, v in detect(text.as_py())}:
                rows.append(row)
                names.append(name)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array(names, pa.string())], names=["row", "entity"]
        )


def _draw(key: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entities, attempts = batch.column("entity").to_pylist(), batch.column("attempt").to_pylist()
            kinds = [e.partition("\0") for e in entities]
            new = [surrogate(key, k, v, a) for (k, _, v), a in zip(kinds, attempts)]
            # Given names of both genders must stay apart as texts, hence only the first part.
            yield pa.RecordBatch.from_arrays(
                [batch.column("entity"), batch.column("attempt"),
                 pa.array([f"{k.partition('/')[0]}\0{n}" for (k, _, _), n in zip(kinds, new)], pa.string()),
                 pa.array([f"{k.partition('/')[0]}\0{v}" for k, _, v in kinds], pa.string())],
                names=["entity", "attempt", "new", "old"],
            )

    return run


def resolved_attempts(entities: DataFrame, key: bytes) -> DataFrame:
    """(entity, attempt) of the distinct ``entities`` that must not take their first draw."""
    schema = "entity string, attempt int, new string, old string"
    drawn = settle(entities.withColumn("attempt", F.lit(0)).mapInArrow(_draw(key), schema))
    while True:
        # Of those that draw one surrogate the one that came to it first keeps it.
        among = drawn.groupBy("new").agg(
            F.min(F.struct(F.col("attempt"), F.col("entity"))).alias("keeps"), F.count("*").alias("n")
        )
        clash = settle(
            drawn.join(among.filter("n > 1"), "new")
            .filter(F.struct("attempt", "entity") != F.col("keeps")).select("entity")
            .unionByName(drawn.join(
                entities_as(drawn), F.col("new") == F.col("value"), "left_semi").select("entity"))
            .distinct()
        )
        if clash.isEmpty():
            return drawn.filter("attempt > 0").select("entity", "attempt")
        again = drawn.join(clash.withColumn("hit", F.lit(1)), "entity", "left").select(
            "entity", (F.col("attempt") + F.coalesce("hit", F.lit(0))).cast("int").alias("attempt")
        )
        drawn = settle(again.mapInArrow(_draw(key), schema))


def entities_as(drawn: DataFrame) -> DataFrame:
    """The values that occur, which no surrogate may be."""
    return drawn.select(F.col("old").alias("value")).distinct()


def _replaced(key: bytes, columns: list[str], text_column: str, again_column: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, again in zip(batch.column(text_column), batch.column(again_column)):
                attempts = dict(a.rpartition("\0")[::2] for a in again.as_py() or [])
                new, n, _ = replace(text.as_py(), key, {e: int(a) for e, a in attempts.items()})
                texts.append(new)
                counts.append(n)
            out = [pa.array(texts, pa.string()) if c == text_column else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(counts, pa.int32())], names=[*columns, "n_entities"]
            )

    return run


def surrogates(docs: DataFrame, key: bytes, text_column: str = "text") -> DataFrame:
    """All rows with surrogates in the text, and how many entities it had (n_entities)."""
    columns = [c for c in docs.columns if c != "n_entities"]
    # A document is known by its text: equal texts have equal entities.
    mark = F.xxhash64(F.col(text_column))
    found = settle(
        docs.select(mark.alias("row"), F.col(text_column).alias("text"))
        .mapInArrow(_entities, "row long, entity string")
    )
    again = resolved_attempts(found.select("entity").distinct(), key)
    again_column, mark_column, row_column = (fresh(docs, c) for c in ("_again", "_mark", "_row"))
    per_text = settle(
        found.distinct().join(again, "entity").groupBy("row").agg(F.collect_set(
            F.concat_ws("\0", "entity", F.col("attempt").cast("string"))
        ).alias(again_column)).withColumnRenamed("row", row_column)
    )
    whole = docs.select(*columns)
    schema = StructType([*whole.schema.fields, StructField("n_entities", IntegerType())])
    return (
        whole.withColumn(mark_column, mark)
        .join(small_side(per_text), F.col(mark_column) == F.col(row_column), "left")
        .drop(mark_column, row_column)
        .mapInArrow(_replaced(key, columns, text_column, again_column), schema)
    )
