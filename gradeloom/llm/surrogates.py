"""Personal data replaced by keyed surrogates.

1. *Detection.* One pass over the text extracts the entities of every document, in order. The words of
   a name that a title marks anywhere in a document are found in the rest of the document without one
   too, alone, together or in capitals. A name word may have inner capitals, hyphens and apostrophes.
2. *Surrogates.* Every word of a name is an entity, the first of several a given name and all others
   family names, so that short and full forms of one name keep belonging together. Each distinct entity
   (kind and canonical value) gets a replacement of its own kind, made from SHA-256 of key, kind,
   canonical value and attempt: digits become digits, letters letters of the same script and case, given
   names names of the same gender and script, family names syllables of the script. Country codes of
   phones, countries of IBANs and first digits of cards stay; check digits of cards and IBANs hold.
   Mail addresses go to reserved domains, below example.com, .net and .org, or .example for all others.
   Initials of middle names become other initials, which needn't be distinct; particles ("van") stay.
3. *Collision checks.* A surrogate that two entities share, or that equals an entity of the corpus, is
   drawn again with the next attempt until all are distinct, so replacement is one to one; equal
   entities keep equal surrogates. Later attempts at words are longer, so there are always enough;
   only numbers can run out.
4. *Rendering.* An occurrence takes the surrogate in its own format (separators, case) and goes back
   to its place; documents without entities aren't moved.

Not detected: names that no title in their document marks, names of more than three words beyond the
third, a known given name before an unknown capitalised word, which is somebody else, names in scripts
without capitals, postal addresses, dates of birth, phone numbers
of bare digits without a leading + or 0 or any separator, secrets of no known prefix that no key word
stands before or that hold no digit, and anything spelled out in words. Two spellings of one IPv6
address count as two entities, and so do a phone number with and without its country code. A word that
is a name in a document goes wherever it stands there as a capitalised word of its own ("Mr. Young", then
"Young people"), also a capitalised word that directly follows a titled name.

DataFrame and SQL functions only.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.session import stored

from .locators import locators, with_files

MAX_BROADCAST_BYTES = 64 << 20
MAX_ATTEMPTS = 200

# Titles by gender, and given and family names by script for surrogates.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Doña", "Г-жа"]
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Don", "Г-н"]
OTHER_TITLES = ["Dr", "Prof"]
FEMALE_NAMES = [
    "Ada", "Agnes", "Alma", "Berta", "Carla", "Clara", "Cora", "Dora", "Edith", "Elsa", "Emma", "Esther", "Eva", "Flora", "Frieda", "Greta",
    "Hanna", "Helga", "Hilda", "Ida", "Ines", "Irma", "Judith", "Karin", "Lena", "Lotte", "Maren", "Martha", "Nora", "Paula", "Rosa", "Vera",
]
MALE_NAMES = [
    "Adam", "Albert", "Anton", "Bruno", "Conrad", "Daniel", "David", "Edgar", "Emil", "Erik", "Felix", "Georg", "Gustav", "Henrik", "Hugo", "Ivo",
    "Jakob", "Jonas", "Julius", "Leo", "Lukas", "Martin", "Max", "Nils", "Oskar", "Otto", "Paul", "Robert", "Simon", "Theo", "Viktor", "Walter",
]
FEMALE_CYRILLIC = ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Раиса", "Софья", "Тамара"]
MALE_CYRILLIC = ["Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев", "Максим", "Олег", "Павел", "Пётр", "Роман"]
FEMALE_GREEK = ["Άννα", "Δήμητρα", "Ειρήνη", "Ελένη", "Κατερίνα", "Μαρία", "Σοφία", "Χρύσα"]
MALE_GREEK = ["Ανδρέας", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"]
# Beginnings, vowels and ends of family names for surrogates, by script.
SYLLABLES = (
    (r"\p{IsCyrillic}", "б в г д ж з к л м н п р с т", "а е и о у", "в вин ев лов н нко р ренко ров т"),
    (r"\p{IsGreek}", "β γ δ ζ θ κ λ μ ν π ρ", "α ε η ι ο ω", "δης κης λας νος πουλος ρης"),
    (r"\p{IsLatin}", "b br d dr f g gr h k kl l m n p r s st t tr v w", "a e i o u", "ck ld ler mann n nd r rt s sen son tz"),
)
# Calling codes of one and two digits; all others have three.
_CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_TITLE = "(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES) + ")"
_HEX = "[0-9a-fA-F]{1,4}"
# Words that join a family name and stay.
PARTICLES = ["von", "van", "der", "den", "de", "del", "della", "di", "da", "du", "la", "le", "zu", "zur", "ten", "ter", "bin", "ibn", "al", "el"]
#: One title, and academic ones behind it.
_TITLES = rf"{_TITLE}\.? (?:(?:{'|'.join(OTHER_TITLES)})\.? )*"
#: A capitalised word of two letters or more; a possessive "'s" isn't part of it.
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]+|(?=['’]\p{Lu}[\p{L}\p{M}]))(?:-\p{Lu}[\p{L}\p{M}]+|['’](?![sS](?!\p{L}))\p{Lu}[\p{L}\p{M}]+)*+"
_BETWEEN = rf"(?:\p{{Lu}}(?:\. ?| )|(?:{'|'.join(PARTICLES)}) )*"
_NAME = rf"{_BETWEEN}(?!(?:{'|'.join(OTHER_TITLES)})(?!\p{{L}})){_WORD}(?: {_BETWEEN}{_WORD}){{0,2}}"
#: Secrets known by how they begin.
_PREFIXES = "AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|[sr]k_live_|[sr]k_test_|xox[abeoprs]-|AIza|hf_|npm_|eyJ"
_PREFIXED = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?:gh[pousr]_|github_pat_|glpat-|[sr]k_(?:live|test)_|hf_|npm_)[A-Za-z0-9_-]{16,255}|sk-[A-Za-z0-9_-]{20,255}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{10,255}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{4,2048}\.[A-Za-z0-9_-]{4,4096}\.[A-Za-z0-9_-]{4,2048}"
)
#: Names of keys whose values are secrets.
_KEY_WORD = r"(?i:passw(?:or)?d|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|secret[_ -]?key|auth[_ -]?key)"
#: Kind and pattern, tried in this order at each place.
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}._+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"),
    ("secret", rf"(?<![\p{{L}}\p{{N}}])(?:[0-9a-fA-F]{{32,128}}|{_PREFIXED})(?![\p{{L}}\p{{N}}])"),
    ("secret", rf"(?<=[\"':= ])(?<={_KEY_WORD}[\"']?[ ]{{0,2}}[:=][ ]{{0,2}}[\"']?)(?=[\p{{L}}+/_=~.-]{{0,99}}[0-9])[A-Za-z0-9+/_=~.-]{{8,512}}(?![\p{{L}}\p{{N}}])"),
    ("ip", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"),
    ("ipv6", rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9a-fA-F:]{{0,39}}[0-9])(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![\p{{L}}\p{{N}}:])"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("card", r"(?<![\p{L}\p{N}])3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4,5}(?![\p{L}\p{N}])"),
    ("card", r"(?<![\p{L}\p{N}])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![\p{L}\p{N}])"),
    ("phone", r"\+[0-9]{1,3}[^\p{L}\p{N}\n]{0,6}\(?[0-9]{2,4}\)?[^\p{L}\p{N}\n]{0,6}[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![\p{L}\p{N}+])\+(?=(?:[ .()/-]{0,2}[0-9]){8,15}(?![0-9]))[1-9][0-9]{0,2}(?:[ .-]?\(0\))?(?:[ ./-]?\(?[0-9]{1,12}\)?){1,6}(?![0-9])"),
    ("phone", r"(?<![\p{L}\p{N}.+-])(?:1[ .-])?(?:\([0-9]{3}\) ?[0-9]{3}[ .-]|[0-9]{3}-[0-9]{3}-|[0-9]{3}\.[0-9]{3}\.|[0-9]{3} [0-9]{3} )[0-9]{4}(?![\p{L}\p{N}-]|\.[0-9])"),
    ("phone", r"(?<![\p{L}\p{N}.,+-])0(?:[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4}|(?:-[0-9]{2}){4})|[1-9][0-9]{8,9}|[0-9]{2,4}[ /-][0-9]{6,8}|[0-9]{2,4} [0-9]{3,4} [0-9]{3,4})(?![\p{L}\p{N}-]|\.[0-9])"),
    ("ssn", r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"),
    ("name", r"(?<![\p{L}\p{N}])" + _TITLES + _NAME),
)
ENTITY = "|".join(p for _, p in PATTERNS)
#: A text without any of these has no entity; a quick test before the patterns.
_QUICK = rf"[0-9@]|{_PREFIXES}|" + _TITLE + r"\.? "


_HEXED = "^[0-9a-fA-F]{32,128}$"


def _kind(value: Column) -> Column:
    tests = [(k, value.rlike(rf"^(?:{p})$")) for k, p in (*PATTERNS, ("name", _NAME))]
    return F.coalesce(*(F.when(t, F.lit(k)) for k, t in tests), F.lit("secret"))  # known by the key word before it


def _canonical(kind: Column, value: Column) -> Column:
    """Equal for all spellings of one entity: digits of numbers, lower case of the rest."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), digits))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when((kind == "secret") & ~value.rlike(_HEXED), value)
        .otherwise(F.lower(value))
    )


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^{_TITLES}", 0)


def _words(value: Column) -> Column:
    """The words of a name, without titles, initials and particles."""
    return F.regexp_extract_all(F.regexp_replace(value, rf"^{_TITLES}", ""), F.lit(_WORD), F.lit(0))


def _lowered(word: Column) -> Column:
    return F.translate(F.lower(word), "’", "'")


def _initials(text: Column, key: str) -> Column:
    """What stands between the words of a name, with other initials."""
    number = lambda c: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}\x1finitial\x1f"), c), 256), 1, 4), 16, 10).cast("int")
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike(r"\p{Lu}"), _letters(c, number(c))).otherwise(c)), "")


def _parts(kind: Column, value: Column, givens: Column, families: Column, key: str) -> Column:
    """The entities of an occurrence: the words of a name with what stands before each, else itself.

    A word of a name is a given name as the first of several behind a title, or where the document has it as one
    and not as a family name too.
    """
    title, words = _title(value), _words(value)
    between = F.split(F.regexp_replace(value, rf"^{_TITLES}", ""), _WORD, -1)

    def part(w: Column, i: Column) -> Column:
        first = (i == 0) & (F.size(words) > 1)
        word = _lowered(w)
        given = (first & (title != "")) | (F.array_contains(givens, word) & (first | ~F.array_contains(families, word)))
        before = F.concat(F.when(i == 0, title).otherwise(""), _initials(F.get(between, i), key))
        return F.struct(F.when(given, F.lit("given")).otherwise(F.lit("family")).alias("entity"), word.alias("word"), w.alias("shown"), before.alias("before"))

    other = F.struct(kind.alias("entity"), _canonical(kind, value).alias("word"), value.alias("shown"), F.lit("").alias("before"))
    return F.when(kind == "name", F.transform(words, part)).otherwise(F.array(other))


def _gender(value: Column) -> Column:
    return (
        F.when(value.rlike("^(?:" + "|".join(FEMALE_TITLES) + r")\.? "), F.lit("f"))
        .when(value.rlike("^(?:" + "|".join(MALE_TITLES) + r")\.? "), F.lit("m"))
        .otherwise(F.lit(""))
    )


def _pick(items: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), F.pmod(n, F.lit(len(items))).cast("int") + 1)


def _letters(c: Column, n: Column) -> Column:
    """A character of the same class, script and case; letters of other scripts become Latin, the rest stays."""
    alphabet = lambda chars: F.substring(F.lit(chars), F.pmod(n, F.lit(len(chars))).cast("int") + 1, F.lit(1))
    return (
        F.when(c.rlike("[0-9]"), alphabet("0123456789"))
        .when(c.rlike("[a-z]"), alphabet("abcdefghijklmnopqrstuvwxyz"))
        .when(c.rlike("[A-Z]"), alphabet("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(c.rlike(r"[\p{IsLatin}&&\p{Ll}]"), alphabet("àâäéèêëîïôöùûüçñ"))
        .when(c.rlike(r"[\p{IsLatin}&&\p{Lu}]"), alphabet("ÀÂÄÉÈÊËÎÏÔÖÙÛÜÇÑ"))
        .when(c.rlike(r"[\p{IsCyrillic}&&\p{Ll}]"), alphabet("абвгдежзиклмнопрст"))
        .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), alphabet("АБВГДЕЖЗИКЛМНОПРСТ"))
        .when(c.rlike(r"[\p{IsGreek}&&\p{Ll}]"), alphabet("αβγδεζηθικλμνξοπρ"))
        .when(c.rlike(r"[\p{IsGreek}&&\p{Lu}]"), alphabet("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡ"))
        .when(c.rlike(r"\p{IsHan}"), alphabet("王李张刘陈杨黄赵周吴"))
        .when(c.rlike(r"\p{Lu}"), alphabet("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(c.rlike(r"\p{L}"), alphabet("abcdefghijklmnopqrstuvwxyz"))
        .otherwise(c)
    )


def _luhn(payload: Column) -> Column:
    """The check digit after the digits of a card."""
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    each = F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.pmod(-F.aggregate(each, F.lit(0), lambda s, x: s + x), F.lit(10)).cast("string")


def _iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an IBAN, by remainders of 97."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), s * 10 + c.cast("int")).otherwise(s * 100 + F.ascii(c) - 55) % 97
    left = F.aggregate(F.split(F.concat(rest, country, F.lit("00")), ""), F.lit(0), step)
    return F.lpad((98 - left).cast("string"), 2, "0")


def _surrogate(kind: Column, value: Column, gender: Column, stream: Column, attempt: Column) -> Column:
    """A replacement from ``stream``, four hexadecimal digits for each character of the value."""
    number = lambda i: F.conv(F.substring(stream, (i * 4).cast("int") + 1, F.lit(4)), 16, 10).cast("int")
    chars = F.split(value, "")
    mapped = F.array_join(F.transform(chars, lambda c, i: _letters(c, number(i))), "")
    after = lambda start: F.substring(mapped, F.length(start) + 1, F.length(mapped))
    hexed = F.array_join(F.transform(chars, lambda c, i: F.substring(stream, (i * 4).cast("int") + 1, F.lit(1))), "")
    begin = F.regexp_extract(value, f"^(?:{_PREFIXES})", 0)
    groups = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(stream, i * 4 + 1, F.lit(4))), ":")
    octets = F.array_join(F.transform(F.split(value, r"\."), lambda c, i: (F.pmod(number(i), F.lit(254)) + 1).cast("string")), ".")
    calling = F.regexp_extract(value, rf"^(?:\+(?:{_CALLING}|[0-9]{{3}})|0)", 0)
    country = F.substring(value, 1, 2)
    rest = F.substring(mapped, F.lit(5), F.length(mapped))
    payload = F.concat(F.substring(value, 1, 1), F.substring(mapped, F.lit(2), F.length(mapped) - 2))
    top = F.regexp_extract(value, r"\.[^.@]+$", 0)
    domain = F.when(top.isin(".com", ".net", ".org"), F.concat(F.lit(".example"), top)).otherwise(F.lit(".example"))
    scripts = ((r"\p{IsCyrillic}", FEMALE_CYRILLIC, MALE_CYRILLIC), (r"\p{IsGreek}", FEMALE_GREEK, MALE_GREEK), (".", FEMALE_NAMES, MALE_NAMES))

    def name(i: Column) -> Column:
        by_script = [
            F.when(value.rlike(script), F.when(gender == "f", _pick(f, number(i))).when(gender == "m", _pick(m, number(i))).otherwise(_pick(f + m, number(i))))
            for script, f, m in scripts
        ]
        return F.coalesce(*by_script)

    def family(onsets: str, vowels: str, ends: str) -> Column:
        """Two syllables and one more for each further attempt."""
        syllable = lambda j: F.concat(_pick(onsets.split(), number(2 * j)), _pick(vowels.split(), number(2 * j + 1)))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 1), syllable), ""), _pick(ends.split(), number(2 * attempt + 4)))

    families = F.coalesce(*(F.when(value.rlike(script), family(*parts)) for script, *parts in SYLLABLES), mapped)
    given = F.array_join(F.transform(F.sequence(F.lit(0), attempt), name), "-")  # a double name at the second attempt
    return (
        F.when((kind == "secret") & value.rlike(_HEXED), hexed)
        .when(kind == "secret", F.concat(begin, after(begin)))
        .when(kind == "ipv6", groups)
        .when(kind == "ip", octets)
        .when(kind == "phone", F.concat(calling, after(calling)))
        .when(kind == "iban", F.concat(country, _iban_check(country, rest), rest))
        .when(kind == "card", F.concat(payload, _luhn(payload)))
        .when(kind == "email", F.concat(F.substring(mapped, F.lit(1), F.length(mapped) - F.length(top)), domain))
        .when(kind == "given", F.lower(given))
        .when(kind == "family", families)
        .otherwise(mapped)
    )


def _drawn(open_: DataFrame, key: str) -> DataFrame:
    """``open_(kind, canonical, gender, attempt)`` with a surrogate; every second attempt at a word is a letter longer."""
    kind, value, attempt = F.col("kind"), F.col("canonical"), F.col("attempt")
    more = F.expr("repeat('a', attempt div 2)")
    longer = F.when(kind == "email", F.concat(more, value)).when(kind.isin("family", "secret"), F.concat(value, more)).otherwise(value)
    seed = F.concat_ws("\x1f", F.lit(key), kind, value, attempt.cast("string"))
    rows = open_.withColumn("value", longer).withColumn("seed", F.sha2(seed, 256))
    blocks = F.sequence(F.lit(0), F.floor((F.length("value") + 2 * attempt + 8) / 16).cast("int"))
    rows = rows.withColumn("stream", F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(F.col("seed"), b.cast("string")), 256)), ""))
    return rows.withColumn("surrogate", _surrogate(kind, F.col("value"), F.col("gender"), F.col("stream"), attempt)).drop("value", "seed", "stream")


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, canonical, surrogate)``: distinct surrogates, none of them an entity of the table.

    Ends with an error only where a kind of numbers has more entities than half its numbers.
    """
    spark = entities.sparkSession
    entities = stored(entities.groupBy("kind", "canonical").agg(F.max("gender").alias("gender")), "entities")
    taken = entities.select("kind", F.col("canonical").alias("surrogate"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settled, open_ = None, entities.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ATTEMPTS):
        drawn = stored(_drawn(open_.repartition(partitions, "canonical"), key), "drawn")  # small rows, much work: over all tasks
        used = taken if settled is None else taken.union(settled.select("kind", "surrogate"))
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("first"))
        fresh = first.join(used.hint("merge"), ["kind", "surrogate"], "left_anti")
        judged = drawn.join(fresh.hint("merge"), ["kind", "surrogate"], "left")
        judged = stored(judged.withColumn("good", F.expr("canonical <=> first")).drop("first"), "judged")
        good = judged.where("good").select("kind", "canonical", "surrogate")
        settled = good if settled is None else settled.union(good)
        open_ = judged.where("not good").select("kind", "canonical", "gender", (F.col("attempt") + 1).alias("attempt"))
        if not open_.limit(1).count():
            return settled
    raise RuntimeError("a kind of numbers has more entities than surrogates")


def _rendered(kind: Column, found: Column, surrogate: Column) -> Column:
    """The surrogate in the format of one occurrence."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def put(state: Column, c: Column) -> Column:
        fixed = F.when(kind == "iban", ~c.rlike("[A-Z0-9]")).otherwise(~c.rlike("[0-9]"))
        char = F.when(fixed, c).otherwise(F.substring(surrogate, state["next"], F.lit(1)))
        return F.struct(F.concat(state["out"], char).alias("out"), F.when(fixed, state["next"]).otherwise(state["next"] + 1).alias("next"))

    capitals = (F.upper(found) == found) & (F.lower(found) != found)
    # a mail address has the capitals of its local part, place by place from the "@" backwards
    local, own = F.split(F.substring_index(found, "@", 1), ""), F.substring_index(surrogate, "@", 1)
    at = lambda i: F.get(local, (i + F.size(local) - F.length(own)).cast("int"))
    own = F.array_join(F.transform(F.split(own, ""), lambda c, i: F.when(at(i) != F.lower(at(i)), F.upper(c)).otherwise(c)), "")
    mail = F.concat(own, F.lit("@"), F.substring_index(surrogate, "@", -1))
    titled = F.array_join(F.transform(F.split(surrogate, "-"), F.initcap), "-")

    surrogate = F.when(kind == "phone", F.regexp_replace(surrogate, "[^0-9]", "")).otherwise(surrogate)
    spaced = F.aggregate(F.split(found, ""), start, put)["out"]
    return (
        F.when(kind.isin("card", "phone", "ssn", "iban"), spaced)
        .when(((kind != "secret") | found.rlike(_HEXED)) & capitals, F.upper(surrogate))
        .when(kind.isin("given", "family"), titled)
        .when(kind == "email", mail)
        .otherwise(surrogate)
    )


def _bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _pattern(names: Column) -> Column:
    return F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{M}\p{N}])(?<!\p{L}['’-])"), names)


def _name_pattern(titled: Column) -> Column:
    """A pattern of the words of titled names, in any order up to three, or an empty text without any."""
    either = lambda words: F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|")

    def forms(words: Column) -> Column:
        """As written and in capitals, with both apostrophes."""
        both = F.concat(F.transform(words, lambda w: F.translate(w, "’", "'")), F.transform(words, lambda w: F.translate(w, "'", "’")))
        return F.array_distinct(F.concat(both, F.transform(both, F.upper)))

    families = forms(_families(titled))
    givens = F.array_except(forms(_givens(titled)), families)
    ends = r"(?![\p{L}\p{M}\p{N}]|-\p{Lu}|['’](?![sS](?!\p{L}))\p{Lu})"
    # a given name before an unknown capitalised word is somebody else's
    lone = F.when(F.size(givens) > 0, F.concat(F.lit("|(?:"), either(givens), F.lit(rf"){ends}(?! (?!{_TITLE}(?!\p{{L}})){_WORD})"))).otherwise("")
    before = F.concat(F.lit("(?:(?:"), either(F.concat(families, givens)), F.lit(rf"){ends} {_BETWEEN}){{0,2}}"))
    return F.when(F.size(titled) > 0, F.concat(before, F.lit("(?:(?:"), either(families), F.lit(rf"){ends}"), lone, F.lit(")"))).otherwise("")


def _givens(titled: Column) -> Column:
    return F.transform(F.filter(titled, lambda x: F.size(_words(x)) > 1), lambda x: _words(x)[0])


def _families(titled: Column) -> Column:
    return F.flatten(F.transform(titled, lambda x: F.when(F.size(_words(x)) > 1, F.slice(_words(x), 2, 9)).otherwise(_words(x))))


def _with_known_names(found: Column) -> Column:
    """What was found in a text, together with untitled mentions of its names, and what finds and sorts these."""
    lowered = lambda words: F.array_distinct(F.transform(words, _lowered))
    again = lambda names: F.when(names != "", F.regexp_extract_all("text", _pattern(names), F.lit(0))).otherwise(found)

    def described(titled: Column) -> Column:
        known = [lowered(_givens(titled)).alias("givens"), lowered(_families(titled)).alias("families")]
        return _bound(_name_pattern(titled), lambda names: F.struct(names.alias("names"), *known, again(names).alias("found")))

    return _bound(F.filter(found, lambda x: x.rlike(rf"^{_TITLES}{_NAME}$")), described)


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` as ``(doc_id, text, n_entities, kinds)``, entities replaced.

    Texts without entities, and null and empty texts, come back as they are (``n_entities`` 0, no
    kinds). Repeated rows give repeated rows with the same replacements; null ids stay null. Other
    columns are dropped. An empty table gives no rows. The same ``key`` always gives the same draw.
    """
    docs = with_files(docs)
    rows = docs.select("doc_id", "text", *locators(docs))
    found = F.when(F.col("text").rlike(_QUICK), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    # one column, bound and stored as it is and not filtered: each use of a part of it would search every text once more
    found = stored(rows.select("file", "row", _bound(found, _with_known_names).alias("of")), "found").select("file", "row", "of.*").where("size(found) > 0")
    pattern = _pattern(F.col("names"))

    each = found.select("file", "row", "names", "givens", "families", F.posexplode("found").alias("at", "value"))
    each = each.withColumn("kind", _kind(F.col("value")))
    parts = _parts(F.col("kind"), F.col("value"), F.col("givens"), F.col("families"), key)
    each = each.select("file", "row", "names", "at", "kind", _gender(F.col("value")).alias("gender"), F.posexplode(parts).alias("part", "p"))
    each = stored(each.select("file", "row", "names", "at", "part", "kind", "gender", "p.*"), "each")
    table = surrogate_table(each.select(F.col("entity").alias("kind"), F.col("word").alias("canonical"), "gender"), key)
    each = each.join(table.select(F.col("kind").alias("entity"), F.col("canonical").alias("word"), "surrogate").hint("merge"), ["entity", "word"])
    inside = _rendered(F.col("entity"), F.col("shown"), F.col("surrogate"))
    piece = F.struct("at", "part", F.concat("before", inside).alias("text"), "kind")
    pieces = each.groupBy(F.col("file").alias("in_file"), F.col("row").alias("in_row")).agg(
        F.first("names").alias("names"), F.array_sort(F.collect_list(piece)).alias("pieces")
    )
    pieces = stored(pieces, "pieces")
    size = F.sum(F.aggregate("pieces", F.length("in_file") + F.length("names") + 64, lambda s, p: s + F.octet_length(p["text"]) + 64))
    small = (pieces.agg(size).first()[0] or 0) <= MAX_BROADCAST_BYTES
    whole = rows.join(pieces.hint("broadcast" if small else "merge"), F.expr("file = in_file and row = in_row"), "left")
    between = F.when(F.col("names") != "", F.split("text", pattern, -1)).otherwise(F.split("text", ENTITY, -1))
    whole = whole.withColumn("between", F.when(F.col("pieces").isNotNull(), between))
    one = lambda p: F.when(p["part"] > 0, p["text"]).otherwise(F.concat(F.get("between", p["at"]), p["text"]))
    replaced = F.concat(F.array_join(F.transform("pieces", one), ""), F.element_at("between", -1))
    return whole.select(
        "doc_id",
        F.when(F.col("pieces").isNotNull(), replaced).otherwise(F.col("text")).alias("text"),
        F.when(F.col("pieces").isNotNull(), F.size("between") - 1).otherwise(0).cast("long").alias("n_entities"),
        F.coalesce(F.array_sort(F.array_distinct("pieces.kind")), F.array().cast("array<string>")).alias("kinds"),
    )
