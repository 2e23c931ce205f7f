"""PII surrogates: detected entities get keyed, type-consistent replacements.

An entity's letters and digits are read as one number in the mixed radix of their
classes (digit, vowel or consonant of a script and case, hexadecimal digit, ...),
the number goes through a keyed Feistel permutation of exactly that range, and the
result is written in the same classes.  So a replacement keeps length, script, case
and format; equal entities get equal replacements in every document (coreference)
and different ones of a format get different ones, without any table.  Card numbers
keep their checksum's validity.  Given names of the lists move one place along a
keyed circle of the names of their gender and script, so none stays itself; a
forename that no list has takes its gender from the title before it and gets an
ending of that gender; surnames keep an ending that tells a gender.

The collision check is a join: replacements that are themselves entities of the
corpus, or that two entities share, are drawn again until none is left.  From draw
``DRAWS`` on a replacement grows by one keyed character a draw, so it leaves any
range that the corpus fills, and the loop ends.
"""

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bitloom.llm.store import drop, materialize

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Carla Clara Elena Emma Eva Helena Ines Irene Julia Laura Lena Lucia Maria Marta Nina Nora Paula Sara Sofia Teresa".split(),
    ("latin", "m"): "Adam Albert Bruno Carlos Daniel David Erik Felix Hugo Ivan Jan Karl Leon Lucas Marco Martin Oscar Pablo Paul Peter Simon Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Григорий Иван Максим Николай Олег Павел Сергей Юрий".split(),
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αλέξανδρος Γιάννης Γιώργος Δημήτρης Κώστας Μιχάλης Νίκος Παύλος Πέτρος".split(),
}
#: Endings of surnames and forenames that tell a gender, longest first.
ENDINGS = ("ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин", "ая", "ий", "οπούλου", "όπουλος", "ίδου", "ίδης")
FORENAME = {("latin", "f"): "a", ("latin", "m"): "o", ("cyrillic", "f"): "а", ("cyrillic", "m"): "н", ("greek", "f"): "α", ("greek", "m"): "ς"}
#: Draws that keep the length; each one after them adds a character.
DRAWS = 8
#: Forms of address and the gender they tell.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Madame": "f", "Monsieur": "m"}
_GENDER = {name.lower(): (script, gender) for (script, gender), names in GIVEN.items() for name in names}

_ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ",
    "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "çñß", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЫЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ",
    "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "άέήίόύώ", "ΆΈΉΊΌΎΏ",
    "åãæõøýÿ", "ÅÃÆÕØÝ", "ðþ", "ÐÞ", "ÇÑ", "йъь", "ЙЪЬ",
)
_CLASS = {c: a for a in _ALPHABETS for c in a}
_HEX = {c: "0123456789abcdef" for c in "0123456789abcdef"}
_CAPS = {c: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
#: Marks of secrets and addresses; they are replaced where an entity has nothing else.
_MARKS = {c: "_-/+" for c in "_-/+"}

_WORD = r"[A-ZÀ-ÖØ-ÞА-ЯΆΈΉΊΌΎΏΑ-Ω][a-zß-öø-ÿа-яάέήίόύώα-ω]+"
_NAMES = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=lambda x: (-len(x), x)))
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w]))"
    r"|(?:(?i:password|passwd|token|secret|api_?key)[\"']?\s*[=:]\s*[\"']?(?P<secret>[A-Za-z0-9_\-/+]{8,}))"
    r"|(?P<key>\bAKIA[A-Z2-7]{12,}\b|\bAKIA[A-Z0-9]{16}\b)"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"
    r"|(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d))"
    rf"|(?P<titled>\b(?P<title>{'|'.join(TITLES)})\b\.? (?P<who>{_WORD}(?: {_WORD})?))"
    rf"|(?P<named>\b(?P<given>{_NAMES}) (?P<sur>{_WORD}))\b"
)
#: A superset of PATTERN that a linear matcher checks first.  Its word boundaries and \d know
#: ASCII only, so names in other scripts go without boundaries and digits by their class.
TRIGGER = (
    r"@|\d\.\d|\d{3}|\+\d|\d-\d|\d(?:[ -]?\d){12}|AKIA|(?i:passw|token|secret|api_?key)".replace(r"\d", r"\p{Nd}")
    + rf"|\b(?:{'|'.join(TITLES)})\b|\b(?:{'|'.join(n for n in _NAMES.split('|') if n.isascii())})\b|{'|'.join(n for n in _NAMES.split('|') if not n.isascii())}"
)


def permute(key: bytes, label: str, x: int, n: int) -> int:
    """A keyed permutation of 0..n-1: eight Feistel rounds, walked until inside."""
    if n <= 1:
        return 0
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    high = bits - low
    while True:
        a, b, wa, wb = x >> low, x & ((1 << low) - 1), high, low
        for r in range(8):
            h = hashlib.blake2b(f"{label}|{n}|{r}|{b}".encode(), key=key, digest_size=64).digest()
            need = int.from_bytes(h, "big")
            while need.bit_length() + 64 < wa:  # long entities need more bits
                h = hashlib.blake2b(h, key=key, digest_size=64).digest()
                need = need << 512 | int.from_bytes(h, "big")
            a, b, wa, wb = b, (a ^ need) & ((1 << wa) - 1), wb, wa
        x = a << wb | b
        if x < n:
            return x


def respell(key: bytes, label: str, text: str, classes=_CLASS) -> str:
    """The text with every classed character replaced inside its class; marks only where nothing is classed."""
    kinds = [classes.get(c) for c in text]
    if not any(kinds):
        kinds = [_MARKS.get(c) for c in text]
    x, n = 0, 1
    for c, a in zip(text, kinds):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    shape = "".join(c if a is None else a[0] for c, a in zip(text, kinds))
    x = permute(key, label + "|" + shape, x, n)
    out = []
    for c, a in zip(reversed(text), reversed(kinds)):
        if a:
            x, i = divmod(x, len(a))
            c = a[i]
        out.append(c)
    return "".join(reversed(out))


def grown(key: bytes, kind: str, canon: str, draw: int) -> str:
    """Keyed characters that a replacement gets from draw ``DRAWS`` on, one more each."""
    letters = "0123456789"
    if kind not in ("phone", "card", "ssn", "ip"):
        last = next((a for a in map(_CLASS.get, reversed(canon)) if a), "aeiou")
        letters = last if not last.isupper() or kind == "key" else last.lower()
    h = int.from_bytes(hashlib.blake2b(f"{kind}|{draw}|{canon}".encode(), key=key).digest(), "big")
    out = []
    for i in range(max(0, draw - DRAWS + 1)):
        if i % 64 == 63:  # a digest has the bits of some 64 characters
            h = int.from_bytes(hashlib.blake2b(f"{h}".encode(), key=key).digest(), "big")
        h, at = divmod(h, len(letters))
        out.append(letters[at])
    return "".join(out)


def luhn(digits: str) -> int:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def _ascii_digits(text: str) -> str:
    return text if text.isascii() else "".join(str(int(c)) if c.isdecimal() else c for c in text)


def canonical(kind: str, text: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return _ascii_digits(re.sub(r"[^\d+]", "", text))
    if kind == "ip":
        return _ascii_digits(text)
    return text if kind in ("key", "secret") else text.lower()


def script(text: str) -> str:
    return "cyrillic" if re.search("[а-яА-Я]", text) else "greek" if re.search("[α-ωάέήίόύώΑ-Ω]", text) else "latin"


def neighbour(key: bytes, name: str) -> str:
    """The next name on a keyed circle of the names of a gender and script."""
    group = _GENDER[name]
    names = sorted((n.lower() for n in GIVEN[group]), key=lambda n: (hashlib.blake2b(n.encode(), key=key).digest(), n))
    return names[(names.index(name) + 1) % len(names)]


def replacement(key: bytes, kind: str, canon: str, draw: int = 0) -> str:
    """The canonical form that stands for ``canon``; ``draw`` counts collisions."""
    label, more = f"{kind}|{draw}", grown(key, kind, canon, draw)
    if kind == "card":
        # the last digit keeps the checksum's remainder, so valid numbers stay valid
        body = canon[0] + respell(key, label, canon[1:-1]) + more
        want = luhn(canon)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)) == want)
    if kind == "phone":
        head = re.match(r"\+1|\+\d{2}|", canon).group()
        rest = canon[len(head) :]
        out = respell(key, label, rest)
        while out[:1] in ("0", "1") and rest[:1] not in ("0", "1"):  # area codes don't begin so; a cycle leads back outside
            out = respell(key, label, out)
        return head + out + more
    if kind == "ssn":
        return respell(key, label, canon) + more
    if kind == "ip":
        x = 0
        for part in canon.split("."):
            x = x * 256 + int(part)
        x = permute(key, label, x, 1 << 32)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0)) + (":" + more if more else "")
    if kind == "email":
        head, dot, top = canon.rpartition(".")
        name, at, host = head.partition("@")
        return respell(key, label, name) + more + at + respell(key, label + "@", host) + dot + top
    if kind == "key":
        return canon[:4] + respell(key, label, canon[4:], _CAPS if set(canon[4:]) <= set(_CAPS) else _CLASS) + more
    if kind == "secret":
        return respell(key, label, canon, _HEX if set(canon) <= set(_HEX) else _CLASS) + more
    if kind == "given":
        return neighbour(key, canon)
    if kind in ("given_f", "given_m"):
        end = FORENAME[script(canon), kind[-1]]
        return respell(key, label, canon[: max(1, len(canon) - len(end))]) + more + end
    end = next((e for e in ENDINGS if canon.endswith(e) and len(canon) >= len(e) + 3), "")
    return respell(key, label, canon.removesuffix(end)) + more + end


def lay(kind: str, surrogate: str, text: str) -> str:
    """The surrogate in the format of the text that it replaces."""
    if kind in ("ip", "key", "secret"):
        return surrogate
    if kind.startswith("given"):
        return surrogate.upper() if len(text) > 1 and text.isupper() else surrogate.capitalize()
    if kind in ("email", "surname"):
        if kind == "surname" and len(surrogate) != len(text):
            return surrogate.capitalize()
        return "".join(s.upper() if i < len(text) and text[i].isupper() else s for i, s in enumerate(surrogate))
    digits = iter(re.sub(r"\D", "", surrogate))
    out = "".join(chr(ord(c) - int(c) + int(next(digits))) if c.isdecimal() else c for c in text)
    return out + "".join(digits)


def entities(text: str):
    """``(start, end, kind)`` of the parts of a text to replace, in order."""
    for m in PATTERN.finditer(text):
        kind = m.lastgroup if m.lastgroup in ("email", "secret", "key", "ip", "ssn", "card", "phone") else None
        kind = kind or next((k for k in ("email", "secret", "key", "ip", "ssn", "card", "phone") if m[k] is not None), None)
        if kind == "ip" and any(int(x) > 255 for x in m["ip"].split(".")):
            continue
        if kind == "card" and luhn(canonical("card", m["card"])):
            continue
        if kind:
            yield m.start(kind), m.end(kind), kind
        elif m["titled"] is not None:
            at = m.start("who")
            parts = m["who"].split(" ")
            if len(parts) == 2:
                yield at, at + len(parts[0]), "given" if parts[0].lower() in _GENDER else "given_" + TITLES[m["title"]]
                at, parts = at + len(parts[0]) + 1, parts[1:]
            for part in parts:
                yield at, at + len(part), "surname"
                at += len(part) + 1
        else:
            yield m.start("given"), m.end("given"), "given"
            yield m.start("sur"), m.end("sur"), "surname"


def _spots(column):
    """Rows that can hold an entity."""
    return pc.fill_null(pc.match_substring_regex(column, TRIGGER), False).to_numpy(zero_copy_only=False).nonzero()[0].tolist()


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", most_sent: int = 100_000) -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced, and ``_n_entities``.

    Null texts stay null and empty texts empty, with no entities.  Equal entities
    get equal surrogates in all rows; repeated rows come out alike.  A listed given
    name may become another name that the corpus holds (names of a gender are few),
    but never itself, nor the same one for two names.  An entity of marks alone gets
    other marks.  Where the corpus fills a format, surrogates are longer.  An input
    column ``_n_entities`` is replaced.  The same key gives the same texts.
    """
    docs = docs.drop("_n_entities")
    place = docs.columns.index(text_col)

    def found(batches):
        for batch in batches:
            seen = {}
            column = batch.column(0)
            for i in _spots(column):
                text = column[i].as_py()
                for a, b, kind in entities(text):
                    seen[kind, canonical(kind, text[a:b])] = None
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())], names=["kind", "canon"])

    known = materialize(docs.select(text_col).mapInArrow(found, "kind string, canon string").distinct(), "entities")

    def drawn(batches):
        for batch in batches:
            kinds, canons, draws = (c.to_pylist() for c in batch.columns)
            made = [replacement(key, k, c, d) for k, c, d in zip(kinds, canons, draws)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=["kind", "canon", "draw", "made"])

    shape = "kind string, canon string, draw int, made string"
    table = materialize(known.withColumn("draw", F.lit(0)).mapInArrow(drawn, shape), "drawn")
    family = F.regexp_replace("kind", "_[fm]$", "").alias("family")  # forenames share one name space
    real = known.select(family, F.col("canon").alias("made")).distinct()
    while True:
        rows = table.select("*", family)
        taken = rows.where("kind <> 'given'").join(real, ["family", "made"], "left_semi").select("kind", "canon")
        first = rows.groupBy("family", "made").agg(F.min(F.struct(F.col("kind") != "given", "draw", "kind", "canon")).alias("first"), F.count("*").alias("n")).where("n > 1")
        shared = rows.join(first, ["family", "made"]).where((F.col("kind") != F.col("first.kind")) | (F.col("canon") != F.col("first.canon"))).select("kind", "canon")
        again = materialize(taken.union(shared).distinct(), "again")
        if not again.take(1):
            drop(again)
            break
        before, marked = table, table.join(again.withColumn("redo", F.lit(True)), ["kind", "canon"], "left")
        redo = marked.where("redo").select("kind", "canon", (F.col("draw") + 1).alias("draw")).mapInArrow(drawn, shape)
        table = materialize(marked.where("redo is null").select("kind", "canon", "draw", "made").union(redo), "drawn")
        drop(before)
        drop(again)
    drop(known)
    redrawn = table.where("draw > 0").select("kind", "canon", "draw")
    few = redrawn.count() <= most_sent
    sent = {(r["kind"], r["canon"]): r["draw"] for r in redrawn.collect()} if few else {}
    schema = StructType([*docs.schema.fields, StructField("_n_entities", LongType())])

    def rewrite(batches):
        @lru_cache(maxsize=50_000)
        def swap(kind, canon, draw):
            return replacement(key, kind, canon, draw)

        for batch in batches:
            own = None if few else batch.column(batch.num_columns - 1).to_pylist()
            columns = list(batch.columns) if few else list(batch.columns)[:-1]
            texts, counts = columns[place].to_pylist(), [0] * batch.num_rows
            for i in _spots(columns[place]):
                text, out, at = texts[i], [], 0
                draws = sent if few else {(x["kind"], x["canon"]): x["draw"] for x in own[i] or ()}
                for a, b, kind in entities(text):
                    canon = canonical(kind, text[a:b])
                    out += [text[at:a], lay(kind, swap(kind, canon, draws.get((kind, canon), 0)), text[a:b])]
                    at = b
                    counts[i] += 1
                texts[i] = "".join(out) + text[at:]
            columns[place] = pa.array(texts, type=columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64())], names=schema.names)

    if few:
        return docs.mapInArrow(rewrite, schema)
    # many redrawn entities: each text gets its own by a join

    def owned(batches):
        for batch in batches:
            rows = []
            for i in _spots(batch.column(0)):
                text = batch.column(0)[i].as_py()
                rows += [(batch.column(1)[i].as_py(), k, canonical(k, text[a:b])) for a, b, k in entities(text)]
            tag, kind, canon = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(tag, pa.int64()), pa.array(kind, pa.string()), pa.array(canon, pa.string())], names=["_tag", "kind", "canon"])

    rows = docs.select(F.struct("*").alias("_row"))  # columns of the input can't clash with ours
    tagged = rows.withColumn("_tag", F.xxhash64(F.coalesce(F.col("_row")[text_col], F.lit(""))))
    per = tagged.select(F.col("_row")[text_col].alias("text"), "_tag").distinct().mapInArrow(owned, "_tag long, kind string, canon string").join(redrawn, ["kind", "canon"])
    per = per.groupBy("_tag").agg(F.collect_set(F.struct("kind", "canon", "draw")).alias("_own"))
    plain = [F.col("_row")[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    return tagged.join(per, "_tag", "left").select(*plain, "_own").mapInArrow(rewrite, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = replace_pii(docs, key=b"a key that the caller keeps")
    return out.select("doc_id", F.col("_n_entities").alias("n_entities"), "text")
