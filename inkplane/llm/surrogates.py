"""Keyed surrogates for personal data in texts (operator 4, DataFrame functions only).

Found: e-mail addresses (of any script), IPv4 and IPv6 addresses, access keys, labelled
hexadecimal tokens, IBANs, payment cards, social security numbers, phone numbers, and
names: up to three words after a title, and the same words with a capital letter anywhere
else in that text, unless the text has the word without a capital too or a pronoun follows
("Will you").
Each distinct entity gets one surrogate from SHA-256 of key, type, canonical form and
try, of the same type: letters stay letters of the same case and script, digits stay
digits, separators stay; cards keep their first digit and pass the Luhn test, IBANs keep
the country and pass the mod-97 test, private addresses stay private, names keep gender
(where the title tells it) and script. Mentions that differ in spelling alone (case,
spaces, dots) share the canonical form, and name words are replaced one by one, so
coreference stays. Not found: names that no title introduces anywhere in their text.

A surrogate that equals another one, or any original of its type, is drawn again with the
next try, so distinct entities stay distinct. Formats with too few values for all of
them (from the sixth try on) get longer ones, one character more with every try, and
addresses others of their kind, so drawing ends whatever the number of entities.

A text's result depends on the text and on the entities of the whole table only, so
equal texts are worked on once. Null texts stay null, empty ones and those without
entity are unchanged, texts of any length are read whole, other columns come along,
whatever their names; ``n_replaced`` is replaced. An empty table gives no rows.

Most texts have neither digit, @ nor title: cheap tests, without which no pattern can
match, come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkplane.llm.common import cut

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Parts of a word are joined by hyphens and apostrophes, but an English genitive is no part; Han names have two to four characters.
_LATIN, _CYRILLIC = r"[\p{L}&&\p{IsLatin}]", r"[\p{L}&&\p{IsCyrillic}]"
_WORD = rf"(?:(?=\p{{Lu}})(?:{_LATIN}++(?:['’-](?!s(?!\p{{L}})){_LATIN}++)*+|{_CYRILLIC}++(?:-{_CYRILLIC}++)*+)|\p{{IsHan}}{{2,4}}+)"
#: Titles by the gender that they tell.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "г-н"),
    "n": ("Dr", "Prof", "Professor", "Professorin", "Doctor", "Doktor", "Docteur", "Doctora", "Доктор", "Профессор"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Госпожа", "г-жа"),
}
TITLES = {sex: (*ts, *(t.upper() for t in ts)) for sex, ts in TITLES.items()}  # in capitals too
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_TITLES = rf"(?<![\p{{L}}])(?=[{''.join(sorted({t[0] for ts in TITLES.values() for t in ts}))}])(?:{_TITLE})\.?(?: (?:{'|'.join(TITLES['n'])})\.?)* "
#: Titles that contain no other one: a text with a title contains one of these.
_SHORTEST = [t for ts in TITLES.values() for t in ts if not any(o != t and o in t for os in TITLES.values() for o in os)]
#: Types with their patterns, first match first. No pattern can start inside the run that it matches.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,40}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f]{3,4}:)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "token": r"(?<=(?i:token|secret|password|key)[\"']{0,1}[ \t]{0,4}[:=][ \t]{0,4}[\"']{0,1})(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{4}){2,7}[A-Z0-9]{1,4}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![A-Za-z0-9])|(?<![A-Za-z0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])",
    "name": rf"{_TITLES}{_WORD}(?: {_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A verb stands before these, no name ("Will you", "May I").
PRONOUNS = ("I", "you", "he", "she", "it", "we", "they")
#: In texts with names every word with a capital letter is looked at.
ANY_OR_WORD = rf"{ANY}|(?<![\p{{L}}\p{{N}}]){_WORD}(?![\p{{L}}\p{{N}}]| (?:{'|'.join(PRONOUNS)})(?![\p{{L}}\p{{N}}]))"
#: Given names for surrogates.
GIVEN = {
    "m-latin": ("Adrian", "Bruno", "Conrad", "Felix", "Hugo", "Julian", "Leon", "Marcus", "Oscar", "Samuel", "Simon", "Victor"),
    "f-latin": ("Alma", "Clara", "Diana", "Elena", "Flora", "Helena", "Irene", "Julia", "Laura", "Marina", "Nora", "Sofia"),
    "m-cyrillic": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл", "Лев", "Максим", "Павел", "Юрий"),
    "n-latin": ("Alex", "Andy", "Charlie", "Chris", "Jamie", "Jordan", "Kim", "Lou", "Max", "Noel", "Robin", "Sam"),
    "n-cyrillic": ("Валя", "Женя", "Никита", "Саша", "Слава", "Шура"),
    "m-han": ("伟国", "志强", "建平", "海明", "文军", "永康"),
    "n-han": ("子安", "小宁", "一云", "思平", "晓晨", "嘉文"),
    "f-han": ("秀兰", "美芳", "玉清", "雪梅", "佳丽", "春燕"),
    "f-cyrillic": ("Алла", "Вера", "Галина", "Дарья", "Елена", "Инна", "Лидия", "Мария", "Нина", "Ольга", "Софья", "Юлия"),
}
SYLLABLES = {
    "latin": ("ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"),
    "cyrillic": ("ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зо"),
    "han": ("安", "柏", "晨", "德", "恩", "芳", "国", "海", "佳", "康", "兰", "明", "宁", "平", "清", "云"),
}
#: Endings of made-up words: given names of men, of people of either sex, of women, and family names.
ENDS = {"latin": "niar", "cyrillic": "ниар", "han": "军文丽林"}
#: Try from which formats get longer, and addresses another kind.
LONGER, OTHER = 6, 12
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _stream(key: str) -> Column:
    """256 hex digits for (type, canon, try)."""
    return F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), "type", "canon", "try", F.lit(n)), 256) for n in range(4)])


def _byte(i: Column) -> Column:
    return F.conv(F.substring("stream", F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(c: Column, i: Column, digits_from: int = 0) -> Column:
    digit = F.pmod(_byte(i), F.lit(10 - digits_from)) + digits_from
    of = lambda letters: F.substring(F.lit(letters), F.pmod(_byte(i), F.lit(len(letters))) + 1, F.lit(1))
    made = F.when(c.rlike("^[0-9]$"), digit.cast("string")).when(c.rlike("^[a-z]$"), of("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("^[A-Z]$"), of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return made.when(c.rlike(r"^\p{IsCyrillic}$"), of("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike(r"^\p{L}$"), of("àáâäèéêëìíîïòóôöùúûüñç")).otherwise(c)


def _by_place(text: Column, keep: Column) -> Column:
    """``text`` with every letter and digit drawn anew, but for the first ``keep``."""
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(i < keep, c).otherwise(_letters(c, i))), "")


def _luhn(text: Column) -> Column:
    """The digit that makes ``text`` pass the Luhn test when appended."""
    digits = F.transform(F.reverse(F.split(text, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return F.pmod(-total, F.lit(10)).cast("string")


def _mod97(text: Column) -> Column:
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("^[0-9]$"), a * 10 + F.conv(c, 16, 10).cast("int")).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)))


def _word(syllables) -> Column:
    """Three syllables, one more for every further try."""
    drawn = F.transform(F.sequence(F.lit(0), F.col("try") + 2), lambda i: F.get(_list(syllables), F.pmod(_byte(i), F.lit(16))))
    return F.initcap(F.array_join(drawn, ""))


def _core() -> Column:
    """The surrogate's canonical form from (type, canon, stream, try)."""
    canon = F.col("canon")
    domain = F.length(canon) - F.length(F.substring_index(canon, ".", -1))  # the last label stays
    email = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(i >= domain, c).otherwise(_letters(c, i))), "")
    part = lambda n: (F.pmod(_byte(F.lit(n)), F.lit(254)) + 1).cast("string")
    ten = F.concat_ws(".", F.lit("10"), part(0), part(1), part(2))
    middle = F.concat_ws(".", F.lit("172"), (F.pmod(_byte(F.lit(3)), F.lit(16)) + 16).cast("string"), part(0), part(1))
    private = F.when(canon.startswith("10."), ten)
    private = private.when(canon.rlike(r"^172\.(1[6-9]|2[0-9]|3[01])\."), F.when(F.col("try") < LONGER, middle).otherwise(ten))
    private = private.when(canon.startswith("192.168."), F.when(F.col("try") < LONGER, F.concat_ws(".", F.lit("192.168"), part(0), part(1))).otherwise(ten))
    # longer ones, once a format has too few values left
    more = F.greatest(F.lit(0), F.col("try") - LONGER + 1)
    tail = F.concat(*[F.substring("stream", 64 * n + 33, 32) for n in range(3, -1, -1)])
    letters, digits_more = F.substring(F.translate(tail, "0123456789", "ghijklmnop"), F.lit(1), more), F.substring(F.translate(tail, "abcdef", "012345"), F.lit(1), more)
    email = F.concat(letters, email)
    unique_local = F.concat(F.lit("fd"), F.substring(tail, 1, 2), *[F.concat(F.lit(":"), F.substring(tail, 3 + 4 * n, 4)) for n in range(7)])
    hexed = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when((c == ":") | ((i < 2) & canon.rlike("^f[cde]")), c).otherwise(F.substring(F.lit("123456789abcdef"), F.pmod(_byte(i), F.lit(15)) + 1, F.lit(1)))), "")
    public = F.concat_ws(".", (F.pmod(_byte(F.lit(0)), F.lit(112)) + 12).cast("string"), part(1), part(2), part(3))
    access = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(i < 4, c).otherwise(F.substring(F.lit(_BASE32), F.pmod(_byte(i), F.lit(32)) + 1, F.lit(1)))), "")
    bban = F.concat(F.substring(_by_place(canon, F.lit(4)), F.lit(5), F.length(canon)), digits_more)
    check = F.lpad((98 - _mod97(F.concat(bban, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    body = F.concat(_by_place(F.substring(canon, F.lit(1), F.length(canon) - 1), F.lit(1)), digits_more)
    digits = F.when(canon.startswith("+"), _by_place(canon, F.lit(2))).otherwise(_by_place(canon, F.lit(0)))
    address = F.when(F.col("try") < OTHER, F.coalesce(private, public)).otherwise(unique_local)
    made = F.when(F.col("type") == "email", email).when(F.col("type") == "ip", address).when(F.col("type") == "key", access)
    made = made.when(F.col("type") == "ipv6", F.when(F.col("try") < LONGER, hexed).otherwise(unique_local))
    hexes = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.substring(F.lit("0123456789abcdef"), F.pmod(_byte(i), F.lit(16)) + 1, F.lit(1))), "")
    made = made.when(F.col("type") == "token", hexes)
    made = made.when(F.col("type") == "iban", F.concat(F.substring(canon, 1, 2), check, bban)).when(F.col("type") == "card", F.concat(body, _luhn(body)))
    made = made.when(F.col("type").isin("ssn", "phone"), F.concat(digits, digits_more))
    for script, syllables in SYLLABLES.items():
        word = _word(syllables)
        for sex, end in zip("mnf", ENDS[script], strict=False):
            names = GIVEN[f"{sex}-{script}"]
            first = F.get(_list(names), F.pmod(_byte(F.lit(0)), F.lit(len(names))))
            made = made.when(F.col("type") == f"given-{sex}-{script}", F.when(F.col("try") == 0, first).otherwise(F.concat(word, F.lit(end))))
        made = made.when(F.col("type") == f"family-{script}", F.concat(word, F.lit(ENDS[script][3])))
    return made


def _type(mention: Column) -> Column:
    """A token's label is not part of the mention: it is known by being hexadecimal and of no other type."""
    rest = [x for x in PATTERNS.items() if x[0] not in ("email", "token")]
    made = reduce(lambda made, x: made.when(mention.rlike(f"^(?:{x[1]})$"), F.lit(x[0])), rest, F.when(mention.rlike(f"^(?:{PATTERNS['email']})$"), F.lit("email")))
    return made.when(mention.rlike("^[0-9A-Fa-f]{32,128}$"), F.lit("token"))


def mentions(texts: DataFrame) -> DataFrame:
    """(id, pos, unit, last, before, surface, type, canon) from (id, found, plain): the parts of every mention that get a surrogate.

    A word by itself is part of a name if the text has it after a title and not among its
    ``plain`` words, those without a capital letter; else its type is null.
    """
    rows = texts.select("id", "plain", F.posexplode("found").alias("pos", "mention")).withColumn("kind", F.coalesce(_type(F.col("mention")), F.lit("word")))
    rows = rows.withColumn("before", F.when(F.col("kind") == "name", F.regexp_extract("mention", f"^{_TITLES}", 0)).otherwise(F.lit("")))
    words = F.split(F.expr("substring(mention, length(before) + 1)"), " ")
    rows = rows.withColumn("surfaces", F.when(F.col("kind") == "name", words).otherwise(F.array("mention")))
    rows = rows.select("*", F.size("surfaces").alias("n"), F.posexplode("surfaces").alias("unit", "surface"))
    first = F.regexp_extract("before", r"^([^ .]+)", 1)
    sex = F.when(first.isin(*TITLES["m"]), "m-").when(first.isin(*TITLES["f"]), "f-").otherwise("n-")
    script = F.when(F.col("surface").rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(F.col("surface").rlike(r"\p{IsHan}"), F.lit("han")).otherwise(F.lit("latin"))
    role = F.when(F.col("unit") == F.col("n") - 1, F.concat(F.lit("family-"), script)).otherwise(F.concat(F.lit("given-"), sex, script))
    kind = F.when(F.col("kind") == "name", role).when(F.col("kind") != "word", F.col("kind"))
    squeezed = F.regexp_replace("surface", r"[ .()-]", "")
    canon = F.when(F.col("kind").isin("iban", "card", "ssn", "phone"), squeezed).when(F.col("kind").isin("email", "token", "ipv6"), F.lower("surface"))
    canon = canon.when(F.col("kind").isin("name", "word"), F.initcap(F.lower("surface"))).otherwise(F.col("surface"))
    canon = F.when((F.col("kind") == "word") & F.array_contains("plain", F.lower("surface")), F.lit(None)).otherwise(canon)
    before = F.when(F.col("unit") == 0, F.col("before")).otherwise(F.lit(" "))
    units = cut(rows.select("id", "pos", "unit", (F.col("unit") == F.col("n") - 1).alias("last"), before.alias("before"), "surface", kind.alias("type"), canon.alias("canon")))
    people = units.filter(F.col("type").rlike("^(given|family)")).groupBy("id", "canon").agg(F.min("type").alias("_type"))  # family names first
    named = units.filter("type IS NULL").join(people, ["id", "canon"], "left").withColumn("type", F.col("_type")).select(units.columns)
    return units.filter("type IS NOT NULL").unionByName(named)


def vocabulary(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, core): a surrogate for every distinct (type, canon), different from all others and all originals."""
    originals = cut(entities.select("type", "canon").distinct())
    waiting, accepted = originals.withColumn("try", F.lit(0)), None
    taken = originals.select("type", F.col("canon").alias("core"))
    while True:
        drawn = waiting.withColumn("stream", _stream(key)).withColumn("core", _core()).drop("stream")
        drawn = cut(drawn)
        used = taken if accepted is None else taken.unionByName(accepted.select("type", "core"))
        free = drawn.groupBy("type", "core").agg(F.min("canon").alias("winner")).join(used, ["type", "core"], "left_anti")  # of those who drew the same, one gets it
        checked = cut(drawn.join(free, ["type", "core"], "left"))
        fine = F.col("winner").eqNullSafe(F.col("canon"))
        good = checked.filter(fine).select("type", "canon", "core")
        accepted = good if accepted is None else accepted.unionByName(good)
        waiting = checked.filter(~fine).select("type", "canon", (F.col("try") + 1).alias("try"))
        if waiting.isEmpty():
            return accepted


def _refit() -> Column:
    """``core`` written the way ``surface`` is: the same separators and case."""
    alnum = F.regexp_replace("core", "[^A-Za-z0-9]", "")

    def step(s: Column, c: Column) -> Column:
        mine = F.substring(alnum, s["i"] + 1, F.lit(1))
        cased = F.when(c.rlike("^[A-Z]$"), F.upper(mine)).otherwise(mine)
        inside = c.rlike("^[A-Za-z0-9]$")
        return F.struct(F.concat(s["out"], F.when(inside, cased).otherwise(c)).alias("out"), (s["i"] + inside.cast("int")).alias("i"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))
    written = F.aggregate(F.split("surface", ""), start, step)["out"]
    # what is longer than the original has no place for every separator
    written = F.when(F.length(alnum) == F.length(F.regexp_replace("surface", "[^A-Za-z0-9]", "")), written).otherwise(F.col("core"))
    cased = F.array_join(F.transform(F.split("surface", ""), lambda c, i: F.when(c != F.lower(c), F.upper(F.substring("core", i + 1, F.lit(1)))).otherwise(F.substring("core", i + 1, F.lit(1)))), "")
    email = F.when(F.length("core") == F.length("surface"), cased).otherwise(F.col("core"))
    upper = (F.length("surface") > 1) & (F.upper("surface") == F.col("surface"))
    name = F.when(upper, F.upper("core")).otherwise(F.col("core"))
    token = F.when(F.col("surface").rlike("[A-F]"), F.upper("core")).otherwise(F.col("core"))
    made = F.when(F.col("type") == "ip", F.col("core")).when(F.col("type").isin("token", "ipv6"), token).when(F.col("type") == "email", email)
    return made.when(F.col("type").rlike("^(given|family)"), name).otherwise(written)


def replace(df: DataFrame, text: str = "text", key: str = "surrogates") -> DataFrame:
    """``df`` with the entities of ``text`` replaced, and ``n_replaced`` (int)."""
    names = [c for c in df.columns if c != "n_replaced"]
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")
    rows = df.select(whole, F.col(text).cast("string").alias("_text"))
    text_ = F.col("_text")
    titled = reduce(lambda a, b: a | b, [text_.contains(t) for t in _SHORTEST]) & text_.rlike(_TITLES)
    worth = text_.contains("@") | text_.rlike("[0-9]") | text_.contains("AKIA") | text_.contains("ASIA") | titled | text_.rlike("[A-Fa-f]{32}")
    has = F.coalesce(worth & text_.rlike(ANY), F.lit(False))
    hits = rows.filter(has).withColumn("id", F.md5("_text")).withColumn("found", F.regexp_extract_all("_text", F.lit(ANY), F.lit(0)))
    named = F.exists("found", lambda m: m.rlike(f"^{PATTERNS['name']}$"))
    hits = hits.withColumn("named", named).withColumn("found", F.when(F.col("named"), F.regexp_extract_all("_text", F.lit(ANY_OR_WORD), F.lit(0))).otherwise(F.col("found")))
    small = F.array_intersect(F.split("_text", r"[^\p{L}\p{N}'’-]+"), F.transform("found", lambda m: F.lower(m)))
    hits = cut(hits.withColumn("plain", F.when(F.col("named"), small).otherwise(F.array().cast("array<string>"))))
    units = cut(mentions(hits.select("id", "found", "plain").distinct()))
    entities = units.filter("type IS NOT NULL")
    made = entities.join(vocabulary(entities, key), ["type", "canon"]).withColumn("new", _refit())
    same = units.filter("type IS NULL").withColumn("new", F.col("surface"))
    every = made.select("id", "pos", "unit", "last", "before", "new", F.lit(1).alias("n")).unionByName(same.select("id", "pos", "unit", "last", "before", "new", F.lit(0).alias("n")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "unit", "last", F.concat("before", "new").alias("new"))))
    by_text = cut(every.groupBy("id").agg(ordered.alias("new"), F.sum(F.when(F.col("last"), F.col("n")).otherwise(0)).cast("int").alias("n_replaced")))
    between = F.when(F.col("named"), F.split("_text", ANY_OR_WORD, -1)).otherwise(F.split("_text", ANY, -1))
    joined = hits.join(by_text, "id").withColumn("between", between)
    rest = F.transform("new", lambda e: F.concat(e["new"], F.when(e["last"], F.get("between", e["pos"] + 1)).otherwise(F.lit(""))))
    changed = joined.select("_row", F.concat(F.get("between", F.lit(0)), F.array_join(rest, "")).alias("_text"), "n_replaced")
    both = rows.filter(~has).select("_row", "_text", F.lit(0).alias("n_replaced")).unionByName(changed)
    columns = [F.col("_text").alias(c) if c == text else F.col("_row")[c].alias(c) for c in names]
    return both.select(*columns, "n_replaced")
