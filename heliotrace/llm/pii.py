"""PII surrogates, from DataFrame functions only.

Detected entities - e-mail addresses, phone numbers, IPv4 addresses, payment cards, social
security numbers, IBANs, access keys, secrets given by name, and persons named by a title - get
keyed surrogates of the same type and format: digits stay digits and letters stay letters in
place, cards keep a valid check digit, octets stay octets, persons get a name of the same gender
and script. A surrogate is a function of the key, the type and the entity's canonical form (its
digits, lower case, or an IBAN without spaces), so an entity has one surrogate in all documents,
however it is spelled. A person counts by name parts, without the title: the family name's
surrogate is drawn from the family name, and a given name's from it with its gender and family,
so a person named in full keeps the family name where only a title and that name follow.

Collisions are checked over the whole corpus: no two entities of a type share a surrogate and no
surrogate is an entity that occurs; for persons this holds for family names, and for given names
of one gender inside a family. Names, addresses and secrets drawn again get longer, and octets get
more digits, so that surrogates do not run out. Entities that fail (all but the least of those that share)
are drawn again with a higher attempt until none is left. Only those need a lookup; the others'
surrogates are computed in place.

Defined results: a null or empty text stays as it is; texts without entities are unchanged, byte
for byte; ids may be null or repeat; all columns are kept in order; an empty table gives an empty
table. Internal column names start with ``__pii_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliotrace.llm.common import store

TITLES = {  # fixed values: title -> gender
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Herr": "m", "Frau": "f", "Monsieur": "m",
    "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Signor": "m", "Signora": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
GIVEN = {  # fixed values: names of one gender and script
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("m", "greek"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Κώστας", "Λουκάς", "Μάριος", "Νίκος", "Πέτρος", "Σπύρος", "Στέλιος", "Τάσος", "Φώτης", "Χρήστος"],
    ("f", "greek"): ["Άννα", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Λυδία", "Μαρία", "Νίκη", "Ξένια", "Όλγα", "Ρένα", "Σοφία", "Χριστίνα"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан", "Юрий"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Софья", "Юлия"],
}
SYLLABLES = {  # fixed values: family names are built of three
    "latin": ["bal", "cor", "den", "fal", "gar", "hol", "kin", "lan", "mar", "nor", "pel", "rad", "sol", "tor", "ver", "wil"],
    "greek": ["βαλ", "γαρ", "δελ", "ζαν", "καρ", "λεν", "μαν", "νικ", "παλ", "ραν", "σαρ", "τολ", "φιλ", "χαρ", "ψαν", "δημ"],
    "cyrillic": ["бал", "вор", "ган", "дем", "жел", "зар", "кол", "лев", "мар", "нов", "пол", "рад", "сол", "тор", "фед", "шел"],
}

_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_UP, _LOW = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆΈ-Ώ", "a-zß-öø-ÿа-яёα-ωά-ώ"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-@])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9][A-Za-z0-9\-]{0,62}(?:\.[A-Za-z0-9][A-Za-z0-9\-]{0,62}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9\-@])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[0-9]{11,28}(?![A-Za-z0-9])",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_\-]?key)[\"']? {0,3}[=:] {0,3}[\"']?[A-Za-z0-9+/_\-]{0,255}[0-9][A-Za-z0-9+/_\-]{0,255}",
    "phone": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])|(?<![A-Za-z0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![A-Za-z0-9.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9.\-])",
    "ssn": r"(?<![A-Za-z0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9\-])",
    "ip": r"(?<![A-Za-z0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![A-Za-z0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9])[3-6](?:[ \-]?[0-9]){12,18}(?![A-Za-z0-9])",
    "person": rf"(?<![{_UP}{_LOW}])(?:{_TITLE})\.? [{_UP}][{_LOW}]{{1,30}}(?: [{_UP}][{_LOW}]{{1,30}}){{0,2}}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_HINT = rf"[0-9@]|A(?:KI|SI)A|(?:{_TITLE})\.? "  # every pattern needs one of these
ENTITIES_PER_TASK = 500
SECRET_HEAD = r"\A[^=:]*[=:] *[\"']?"


def kind_of(entity: Column) -> Column:
    out = F.when(entity.contains("@") & ~entity.rlike(r"[=:]"), "email").when(entity.rlike(r"\A(?:AKIA|ASIA)[A-Z0-9]{16}\z"), "access_key").when(entity.rlike(r"[=:]"), "secret")
    out = out.when(entity.rlike(r"\A[A-Z]{2}[0-9]{2}"), "iban").when(entity.rlike(r"\A[0-9]{1,3}(?:\.[0-9]{1,3}){3}\z"), "ip").when(entity.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), "ssn")
    return out.when(entity.rlike(r"\A[+(]|\A[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}\z"), "phone").when(entity.rlike(r"\A[0-9]"), "card").otherwise("person")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def canonical_of(kind: Column, entity: Column) -> Column:
    """What all spellings of one entity have in common."""
    out = F.when(kind.isin("phone", "card", "ssn"), F.concat(F.when(entity.startswith("+"), "+").otherwise(""), _digits(entity)))
    out = out.when(kind.isin("email", "family", "given"), F.lower(entity)).when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
    return out.when(kind == "secret", F.regexp_replace(entity, SECRET_HEAD, "")).otherwise(entity)


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """256 hex digits that only the key's holder can draw for an entity: a nested keyed digest, twice."""
    part = lambda n: F.sha2(F.concat(F.lit(key), F.sha2(F.concat_ws("|", F.lit(f"{key}{n}"), kind, attempt.cast("string"), canon), 512)), 512)
    return F.concat(part(0), part(1))


def _draw(stream: Column, i: Column, n) -> Column:
    """The i-th number below n, from two hex digits."""
    return F.conv(F.substring(stream, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int") % n


def _like(text: Column, stream: Column, *, hex_only: Column | None = None) -> Column:
    """Every letter and digit replaced by one of its own class, in place."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters: F.substring(F.lit(letters), _draw(stream, i, len(letters)) + 1, F.lit(1))
        hexed = F.when(c.rlike("[0-9a-f]"), pick("0123456789abcdef")) if hex_only is not None else None
        plain = F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        return F.when(hex_only, F.coalesce(hexed, c)).otherwise(plain) if hex_only is not None else plain

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _refill(entity: Column, digits: Column, places: str = "[0-9]") -> Column:
    """The entity's digits (or other ``places``) replaced in order; all else stays."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("j"))
    step = lambda a, c: F.when(c.rlike(places), F.struct(F.concat(a["out"], F.substring(digits, a["j"] + 1, F.lit(1))).alias("out"), (a["j"] + 1).alias("j"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["j"].alias("j")))
    return F.aggregate(F.split(entity, ""), start, step, lambda a: a["out"])


def _luhn(digits: Column) -> Column:
    """Sum of a card number's digits by the check rule, modulo 10."""
    number = lambda c: c.cast("int")
    double = lambda c: F.when(number(c) > 4, number(c) * 2 - 9).otherwise(number(c) * 2)
    parts = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 1, double(c)).otherwise(number(c)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10


def is_entity(kind: Column, entity: Column) -> Column:
    """Cards need a valid check digit; all else that the pattern finds is an entity."""
    return F.when(kind == "card", _luhn(_digits(entity)) == 0).otherwise(F.lit(True))


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def surrogate(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """The replacement of an entity other than a name, in the entity's own spelling."""
    return _let(canonical_of(kind, entity), lambda canon: _let(_stream(key, kind, canon, attempt), lambda stream: _in_place(kind, entity, canon, stream, attempt)))


def _in_place(kind: Column, entity: Column, canon: Column, stream: Column, attempt: Column) -> Column:
    """Higher attempts draw from more: addresses and secrets get longer, octets get more digits."""
    digits = _digits(entity)
    longer = F.substring(stream, F.lit(201), F.least(F.lit(16), F.floor(attempt / 4).cast("int")))
    drawn = F.array_join(F.transform(F.split(digits, ""), lambda c, i: _draw(stream, i, 10).cast("string")), "")
    # phone: the country code stays; card: the network's digit stays and the last digit makes the number valid
    country = F.when(entity.startswith("+"), F.length(F.regexp_extract(entity, r"\A\+([0-9]{1,3})", 1))).otherwise(0)
    phone = _refill(entity, F.concat(F.substring(digits, F.lit(1), country), F.substring(drawn, country + 1, F.length(drawn))))
    body = F.concat(F.substring(digits, 1, 1), F.substring(drawn, F.lit(2), F.length(drawn) - 2))
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    card = _refill(entity, F.concat(body, check.cast("string")))
    ssn = _refill(entity, F.concat((100 + _draw(stream, F.lit(100), 200) + _draw(stream, F.lit(101), 200)).cast("string"), F.substring(drawn, 4, 6)))
    places = lambda o: F.length(o) + F.floor(attempt / 4).cast("int")
    octet = lambda o, i: F.when(places(o) >= 3, 100 + _draw(stream, i, 156)).when(places(o) == 2, 10 + _draw(stream, i, 90)).otherwise(1 + _draw(stream, i, 9)).cast("string")
    ip = F.array_join(F.transform(F.split(entity, r"\."), octet), ".")
    domain = F.substring_index(entity, "@", -1)
    name, top = F.substring_index(entity, "@", 1), F.substring_index(domain, ".", -1)
    labels = F.split(domain, r"\.")
    host = F.slice(labels, F.lit(1), F.greatest(F.lit(0), F.size(labels) - 2))
    mapped = _like(F.concat_ws(".", F.array_append(host, name)), stream)  # name's and host's characters share no draw
    parts = F.split(mapped, r"\.")
    local = F.array_join(F.slice(parts, F.size(host) + 1, F.greatest(F.lit(1), F.size(parts) - F.size(host))), ".")
    safe = F.when(F.lower(top).isin("com", "net", "org"), F.concat(F.lit("example."), top)).otherwise(F.concat(F.lit("example."), top))
    email = F.concat(local, longer, F.lit("@"), F.when(F.size(host) > 0, F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(host)), "."), F.lit("."))).otherwise(F.lit("")), safe)
    head = F.regexp_extract(entity, SECRET_HEAD, 0)
    secret = F.concat(head, _like(canon, stream, hex_only=canon.rlike(r"\A[0-9a-f]+\z")), longer)
    access = F.concat(F.substring(entity, 1, 4), F.substring(_like(entity, stream), 5, 64))
    iban = _refill(entity, F.concat(F.substring(canon, 1, 2), F.substring(_like(canon, stream), 3, 64)), "[A-Z0-9]")
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "ip", ip).when(kind == "secret", secret).when(kind == "access_key", access).when(kind == "iban", iban)


def _title(person: Column) -> Column:
    return F.regexp_extract(person, rf"\A(?:{_TITLE})\.?", 0)


def parts_of(kind: Column, entity: Column) -> Column:
    """(kind, entity) of what has a surrogate of its own: an entity, or a person's name parts in order.

    One word behind a title is a family name; of more the last is and the others are given names,
    each as gender|family|name.
    """
    title = _title(entity)
    gender = F.when(F.regexp_replace(title, r"\.", "").isin(*[t for t, g in TITLES.items() if g == "f"]), "f").otherwise("m")
    words = F.split(F.substring(entity, F.length(title) + 2, F.length(entity)), " ")
    part = lambda k, e: F.struct(F.lit(k).alias("kind"), e.alias("entity"))
    names = F.transform(words, lambda w, i: F.when(i == F.size(words) - 1, part("family", w)).otherwise(part("given", F.concat_ws("|", gender, F.element_at(words, -1), w))))
    return F.when(kind == "person", names).otherwise(F.array(F.struct(kind.alias("kind"), entity.alias("entity"))))


def name_surrogate(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """A family name of four syllables, or a given name behind its gender and family; higher attempts take more."""
    name = F.substring_index(entity, "|", -1)
    script = lambda f: F.when(name.rlike("[А-яЁё]"), f("cyrillic")).when(name.rlike("[Α-ωΆ-ώ]"), f("greek")).otherwise(f("latin"))
    count = lambda least, step, most: F.least(F.lit(most), F.lit(least) + F.floor(attempt / step).cast("int"))

    def drawn(stream: Column) -> Column:
        some = lambda n, values, at: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(F.array(*map(F.lit, values)), _draw(stream, i + at, len(values)) + 1))
        family = script(lambda s: F.initcap(F.array_join(some(count(4, 4, 8), SYLLABLES[s], 60), "")))
        given = lambda g: script(lambda s: F.array_join(some(count(1, 2, 4), GIVEN[g, s], 0), "-"))
        head = F.substring(entity, F.lit(1), F.length(entity) - F.length(name))
        return F.when(kind == "family", family).otherwise(F.concat(head, F.when(entity.startswith("f|"), given("f")).otherwise(given("m"))))

    return _let(_stream(key, kind, F.lower(entity), attempt), drawn)


def replacement(key: str, entity: Column, attempt) -> Column:
    """An entity's surrogate in its own spelling, a person's title kept; ``attempt`` gives each part's attempt from its kind and canonical form."""
    name = lambda p: _let(attempt(p["kind"], F.lower(p["entity"])), lambda n: F.substring_index(name_surrogate(key, p["kind"], p["entity"], n), "|", -1))
    person = F.concat(_title(entity), F.lit(" "), F.array_join(F.transform(parts_of(F.lit("person"), entity), name), " "))
    other = lambda kind: _let(attempt(kind, canonical_of(kind, entity)), lambda n: surrogate(key, kind, entity, n))
    return _let(kind_of(entity), lambda kind: F.when(kind == "person", person).when(is_entity(kind, entity), other(kind)).otherwise(entity))


def found(text: Column) -> Column:
    """All candidate entities of a text, in order."""
    return F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, canon, entity) of all parts: the entity is the least spelling."""
    spelled = docs.select(F.explode(F.array_distinct(found(F.col(text_col)))).alias("entity"))
    spelled = spelled.groupBy("entity").count().select("entity").withColumn("kind", kind_of(F.col("entity"))).where(is_entity(F.col("kind"), F.col("entity")))
    spelled = spelled.select(F.explode(parts_of(F.col("kind"), F.col("entity"))).alias("p")).select("p.kind", "p.entity")
    return spelled.withColumn("canon", canonical_of(F.col("kind"), F.col("entity"))).groupBy("kind", "canon").agg(F.min("entity").alias("entity"))


def redrawn(entities_: DataFrame, key: str, *, max_attempts: int = 64) -> DataFrame | None:
    """(kind, canon, attempt) of the entities whose first draw collides; None if there is none."""
    part = [F.col(c) for c in ("kind", "entity", "attempt")]
    drawn = lambda df: df.withColumn("to", F.when(part[0].isin("family", "given"), name_surrogate(key, *part)).otherwise(surrogate(key, *part))).withColumn("to", canonical_of(F.col("kind"), F.col("to")))
    parts = max(12, entities_.count() // ENTITIES_PER_TASK)  # a digest for each entity: too much for the few tasks that its bytes would get
    state = store(drawn(entities_.repartition(parts, "kind", "canon").withColumn("attempt", F.lit(0))), "surrogates")
    for n in range(1, max_attempts + 1):
        now = state.read()
        keepers = now.groupBy("kind", "to").agg(F.min(F.struct("attempt", "canon")).alias("keeper"), F.count("*").alias("n")).where("n > 1")
        twice = now.join(keepers, ["kind", "to"]).where(F.struct("attempt", "canon") != F.col("keeper")).select("kind", "canon")
        real = now.join(now.select("kind", F.col("canon").alias("to")), ["kind", "to"], "left_semi").select("kind", "canon")
        bad = twice.union(real).distinct()
        if not bad.limit(1).count():
            out = now.where("attempt > 0").select("kind", "canon", "attempt")
            return out if n > 1 else None
        again = now.join(bad.withColumn("bad", F.lit(True)), ["kind", "canon"], "left").withColumn("attempt", F.when(F.col("bad"), F.lit(n)).otherwise(F.col("attempt"))).drop("bad", "to")
        old, state = state, store(drawn(again), "surrogates")
        old.drop()
    raise ValueError(f"entities still share surrogates after {max_attempts} draws")


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The table with every entity of the text column replaced."""
    text = F.col(text_col)
    entity_table = store(entities(docs, text_col), "entities")
    draws = redrawn(entity_table.read(), key)
    work = docs.withColumn("__pii_found", found(text))
    if draws is not None:
        # Few entities need a lookup, so few texts do: these are met by a digest of the text, the rest stay in place.
        digest = F.struct(F.xxhash64(text), F.xxhash64(text, F.lit(1)))
        spelled = docs.select(F.explode(F.array_distinct(found(text))).alias("entity"), digest.alias("__pii_text"))
        spelled = spelled.select(F.explode(parts_of(kind_of(F.col("entity")), F.col("entity"))).alias("p"), "__pii_text").select("p.kind", "p.entity", "__pii_text")
        spelled = spelled.withColumn("canon", canonical_of(F.col("kind"), F.col("entity")))
        by_text = spelled.join(draws, ["kind", "canon"]).groupBy("__pii_text").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("__pii_attempts"))
        lookup = store(by_text, "redrawn").read()
        n = lookup.count()
        work = work.withColumn("__pii_text", digest).join(F.broadcast(lookup) if n <= 50_000 else lookup, "__pii_text", "left").drop("__pii_text")
        attempt = lambda kind, canon: F.coalesce(F.element_at("__pii_attempts", F.concat_ws("|", kind, canon)), F.lit(0))
    else:
        attempt = lambda kind, canon: F.lit(0)
    replaced = F.transform("__pii_found", lambda e: replacement(key, e, attempt))
    between = F.split(text, ENTITY, -1)
    joined = F.array_join(F.zip_with(between, replaced, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return work.select(*(F.when(F.size("__pii_found") > 0, joined).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


KEY = "heliotrace example key"  # a parameter in production


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    replaced = replace_pii(docs.select("doc_id", "text", F.sha2("text", 256).alias("before")), KEY)
    return replaced.select("doc_id", "text", (F.sha2("text", 256) != F.col("before")).alias("changed"))
