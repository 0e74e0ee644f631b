"""Replacement of personal data by keyed surrogates, in DataFrame operations only.

One pattern finds e-mail addresses, IP addresses of both versions, phone numbers (international, or of ten digits as written
in North America with brackets, points or hyphens), social security numbers (3-2-4 digits), account numbers of 13 to 19 digits
or with their country, secrets and names after a form of address; where a text has such names, their parts are found in the rest of that text as well. Entities fall into units
(a name's parts, an address's local part and domain, else the whole), and each unit of the corpus gets one surrogate of the
same class, script, gender, letter case and format, drawn from a keyed hash: a unit is replaced by the same surrogate
wherever it stands. The surrogates of all units are checked: one that two units share, or that is a unit itself, is drawn
again for all but the first, until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, let

MALE = "Mr|Herr|Señor|Monsieur|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Madame|Mme|г-жа"
OTHER = "Dr|Prof"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.)+\p{L}{2,24}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
#: In full, with zeros left out in the middle, or (if it has a digit) at an end.
IP6 = rf"(?<![0-9A-Za-z:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?=[A-Fa-f:]*[0-9])(?:::(?:{_HEX}:){{0,6}}{_HEX}|(?:{_HEX}:){{1,7}}:))(?![0-9A-Za-z:])"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
NATIONAL = r"(?<![0-9\p{L}(+-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9\p{L}-])"
SSN = r"(?<![0-9\p{L}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\p{L}-])"
#: Digits in a row or in groups of three or more but for the last; single digits with spaces between are a list of numbers.
ACCOUNT = r"(?<![0-9\p{L}])(?=[0-9](?:[ -]?[0-9]){12,18}(?![0-9\p{L}]))(?:[0-9]{13,19}|(?:[0-9]{3,8}[ -])+[0-9]{1,8})(?![0-9\p{L}])"
#: Keys of cloud accounts, bank accounts with their country (a check number and at least eight digits more), and runs with a digit.
SECRET = r"(?<![\p{L}\p{N}_-])(?:AKIA[0-9A-Z]{16}|[A-Z]{2}[0-9]{2}(?=(?:[A-Z]*[0-9]){8})[A-Z0-9]{11,30}|(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{24,})(?![\p{L}\p{N}_-])"
_TITLE = f"(?:{MALE}|{FEMALE}|{OTHER})"
_NAME = r"(?:\p{Lu}(?:\.|(?:['’](?=\p{Lu}))?[\p{L}\p{M}]++(?:['’-]\p{L}{2,}+)*)|\p{Lo}[\p{L}\p{M}]*+)"
PERSON = rf"(?<!\p{{L}}){_TITLE}\.? {_NAME}(?: (?!{_TITLE}(?!\p{{L}})){_NAME})*"
#: An account number that is a run of digits would match as a secret too; what stands first wins.
PATTERN = "|".join((EMAIL, IP, IP6, PHONE, NATIONAL, SSN, ACCOUNT, SECRET, PERSON))

#: Draws of a surrogate after which the space of a class is taken to be exhausted.
DRAWS = 64
# Of each script its name in patterns, sixteen letters to draw from for the odd and for the even places of a name, and the
# endings of male and female given names, if it has such.
_SCRIPTS = (
    ("Latin", "bcdfghklmnprstvz", "aeiouaeiouaeiouy", "o", "a"),
    ("Cyrillic", "бвгдзклмнпрстфхц", "аеиоуаеиоуаеиоуя", "н", "а"),
    ("Greek", "βγδζθκλμνξπρστφχ", "αεηιοαεηιοαεηιου", "ς", "α"),
    ("Armenian", "բգդզլկհձմնպսվտրֆ", "աեէըիոաեէըիոաեէը", "ն", "ա"),
    ("Georgian", "ბგდვზთკლმნპრსტფქ", "აეიოუაეიოუაეიოუა", None, None),
    ("Hebrew", "בגדהוזחטכלמנפצקש", "בגדהוזחטכלמנפצקש", None, None),
    ("Arabic", "بتثجحدرسشصطعفقلم", "اوياوياوياوياويا", None, None),
    ("Devanagari", "कगचजटडतदनपबमरलवस", "कगचजटडतदनपबमरलवस", None, None),
    ("Thai", "กขคงจชดตทนบปพมรส", "กขคงจชดตทนบปพมรส", None, None),
    ("Hangul", "가나다라마바사아자차카타파하고노", "가나다라마바사아자차카타파하고노", None, None),
    ("Hiragana", "あいうかきこさしたてなにはまらり", "あいうかきこさしたてなにはまらり", None, None),
    ("Katakana", "アイウカキコサシタテナニハマラリ", "アイウカキコサシタテナニハマラリ", None, None),
    ("Han", "山川木水火土金田石林森中大小东西", "山川木水火土金田石林森中大小东西", None, None),
)


def _parts(person: Column) -> Column:
    """The parts of a name with its form of address, as structs of class, gender and text; initials and forms of address have no class."""
    words = F.split(person, " ")
    title = F.get(words, F.lit(0))
    gender = F.when(title.rlike(rf"^(?:{MALE})\.?$"), "m").when(title.rlike(rf"^(?:{FEMALE})\.?$"), "f").otherwise("")

    def part(word: Column, at: Column) -> Column:
        kind = F.when((at == 0) | word.endswith("."), "").when(at == F.size(words) - 1, "surname").otherwise("given")
        return F.struct(kind.alias("kind"), F.when(kind == "given", gender).otherwise("").alias("gender"), word.alias("unit"))

    return F.transform(words, part)


def _names(entities: Column) -> Column:
    """The name parts among the entities of a text, those with a gender first."""
    persons = F.filter(entities, lambda e: e.rlike(rf"^{_TITLE}\.? "))
    parts = F.filter(F.flatten(F.transform(persons, _parts)), lambda x: x["kind"] != "")
    return let(F.array_distinct(parts), lambda x: F.concat(F.filter(x, lambda y: y["gender"] != ""), F.filter(x, lambda y: y["gender"] == "")))


def _pattern(names: Column) -> Column:
    """The pattern of a text that has these names: they are found without a form of address, too."""
    own = F.array_join(F.array_distinct(F.transform(names, lambda x: x["unit"])), "|")
    return F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), own, F.lit(r")(?!\p{L})"))


def _units(entity: Column, names: Column) -> Column:
    """The units of an entity, in order, as structs of class, gender, text and separator after it; the class of what stays is ''.

    In one text, a given name without a gender has that of the same name with one.
    """
    unit = lambda kind, g, text, sep: F.struct(kind.alias("kind"), g.alias("gender"), text.alias("unit"), sep.alias("sep"))
    none = F.lit("")

    def named(part: Column) -> Column:
        same = F.get(F.filter(names, lambda x: (x["unit"] == part["unit"]) & (x["kind"] == part["kind"])), F.lit(0))
        return F.when(part["gender"] != "", part["gender"]).otherwise(F.coalesce(same["gender"], none))

    person = let(_parts(entity), lambda p: F.transform(p, lambda x, i: unit(x["kind"], named(x), x["unit"], F.when(i < F.size(p) - 1, " ").otherwise(""))))
    bare = F.get(F.filter(names, lambda x: x["unit"] == entity), F.lit(0))
    at = F.split(entity, "@")
    address = F.array(unit(F.lit("local"), none, F.get(at, F.lit(0)), F.lit("@")), unit(F.lit("domain"), none, F.get(at, F.lit(1)), none))
    kinds = ((IP, "ip"), (IP6, "ip6"), (SSN, "ssn"), (NATIONAL, "national"), (ACCOUNT, "account"))
    whole = F.when(entity.startswith("+"), "phone")
    for pattern, kind in kinds:
        whole = whole.when(entity.rlike(rf"^(?:{pattern})$"), kind)
    return (
        F.when(entity.rlike(rf"^(?:{EMAIL})$"), address)
        .when(entity.rlike(rf"^(?:{PERSON})$"), person)
        .when(bare.isNotNull(), F.array(unit(bare["kind"], bare["gender"], entity, none)))
        .otherwise(F.array(unit(whole.otherwise("secret"), none, entity, none)))
    )


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _draw(key: str) -> Column:
    """The surrogate of the unit in the columns kind, gender, unit and draw."""
    kind, unit, gender, draw = F.col("kind"), F.col("unit"), F.col("gender"), F.col("draw")
    # the letter case of a name is that of its use; its digest is that of the name
    folded = F.when(kind.isin("given", "surname", "domain", "local"), F.lower(unit)).otherwise(unit)
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, gender, folded, draw.cast("string")), 512)
    number = lambda c: F.instr(F.lit("0123456789abcdef"), c)  # noqa: E731  1 to 16

    name = kind.isin("given", "surname")

    def letters(c: Column, i: Column, h: Column) -> Column:
        """A letter of the script and case of c: in names, consonants and vowels in turn, the last as in the name; else any of
        the script's consonants. A letter of another script becomes one beside it."""
        lower = F.lower(c)
        out = F.lit(None).cast("string")
        for script, hard, soft, *_ in _SCRIPTS:
            vowel = F.when(i == F.length(unit) - 1, F.instr(F.lit(soft), lower) > 0).otherwise(i % 2 == 1)
            alphabet = F.when(name & vowel, F.lit(soft)).otherwise(F.lit(hard))
            out = F.coalesce(out, F.when(lower.rlike(rf"\p{{Is{script}}}"), F.substr(alphabet, number(h), F.lit(1))))
        code = F.conv(F.hex(F.encode(lower, "UTF-16BE")), 16, 10).cast("long")
        beside = F.decode(F.unhex(F.lpad(F.hex(code.bitwiseXOR(number(h).cast("long"))), 4, "0")), "UTF-16BE")
        out = F.coalesce(out, F.when((code < 0xD800) & beside.rlike(r"^\p{L}$"), beside), lower)
        return F.when(c == lower, out).otherwise(F.upper(out))

    def character(c: Column, i: Column) -> Column:
        h = F.substr(digest, i % 128 + 1, F.lit(1))
        digit = F.translate(h, "abcdef", "024681")
        kept = (kind == "phone") & (i <= F.instr(F.regexp_replace(unit, "[ (.-]", " "), F.lit(" ")))  # the country's code
        hexadecimal = ((kind == "secret") & unit.rlike("^[0-9a-fA-F]+$")) | ((kind == "ip6") & (c != ":"))
        return (
            F.when(kept, c)
            .when(hexadecimal, F.when((F.upper(unit) == unit) & (F.lower(unit) != unit), F.upper(h)).otherwise(h))
            .when(c.rlike("[0-9]"), digit)
            .when(c.rlike(r"\p{L}"), letters(c, i, h))
            .otherwise(c)
        )

    spelled = lambda text: F.array_join(F.transform(F.split(text, ""), character), "")
    # short names have few surrogates of their length: later draws are longer
    longer = F.concat(unit, F.repeat(F.substr(F.lower(unit), F.length(unit), F.lit(1)), F.when(name | (kind == "local"), F.floor(draw / 4)).otherwise(0).cast("int")))

    def gendered(spelled_name: Column) -> Column:
        """The name with the ending of its gender in its script."""
        last = F.lower(F.substr(spelled_name, F.length(spelled_name), F.lit(1)))
        ending = F.lit(None).cast("string")
        for script, _, _, male, female in _SCRIPTS:
            if male:
                ending = F.coalesce(ending, F.when(last.rlike(rf"\p{{Is{script}}}"), F.when(gender == "m", male).when(gender == "f", female)))
        changed = F.concat(F.substr(spelled_name, F.lit(1), F.length(spelled_name) - 1), _cased(ending, spelled_name))
        return F.coalesce(F.when(F.length(spelled_name) > 1, changed), spelled_name)

    octet = lambda k: (F.conv(F.substr(digest, F.lit(2 * k + 1), F.lit(2)), 16, 10).cast("int"))
    # reserved addresses first, any when there are too many
    address = F.concat_ws(".", F.when(draw < 8, octet(0) % 15 + 240).otherwise(octet(0)).cast("string"), *[octet(k).cast("string") for k in (1, 2, 3)])
    checked = let(  # a number with a valid check digit gets one with a valid check digit
        spelled(unit),
        lambda s: F.coalesce(
            F.get(
                F.filter(
                    F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(F.substr(s, F.lit(1), F.length(s) - 1), d.cast("string"))),
                    lambda x: _luhn(F.regexp_replace(x, "[ -]", "")),
                ),
                F.lit(0),
            ),
            s,
        ),
    )
    # there are few short addresses: later draws are in full
    groups = F.concat_ws(":", *[F.substr(digest, F.lit(4 * k + 1), F.lit(4)) for k in range(8)])
    return (
        F.when(kind == "ip", address)
        .when((kind == "ip6") & (draw >= 4), groups)
        .when(kind == "domain", let(F.concat(F.substr(F.translate(digest, "0123456789", "ghijklmnop"), F.lit(1), F.lit(12)), F.lit(".example.net")), lambda d: F.when(F.upper(unit) == unit, F.upper(d)).otherwise(d)))
        .when(kind == "account", F.when(_luhn(F.regexp_replace(unit, "[ -]", "")), checked).otherwise(spelled(unit)))
        .when(kind == "given", let(spelled(longer), gendered))
        .otherwise(spelled(longer))
    )


def _cased(letter: Column, like: Column) -> Column:
    return F.when((F.upper(like) == like) & (F.length(like) > 1), F.upper(letter)).otherwise(letter)


def surrogates(units: DataFrame, key: str) -> DataFrame:
    """``kind``, ``gender``, ``unit`` and ``surrogate`` of each unit of a table with kind, gender and unit; no two units of a kind
    share one, and none is a unit of its kind. Units that differ in letter case only count as one for this check. A unit without a
    gender has the surrogate of the same unit with one, if there is one (of the first gender, if there are two).

    A kind of which there are more units than surrogates of its format, such as phone numbers of one country, is an error.
    """
    asked = checkpointed(units.where("kind <> ''").select("kind", "gender", "unit").distinct())
    known = asked.where("gender <> ''").groupBy("kind", F.lower("unit").alias("folded")).agg(F.min("gender").alias("settled"))
    asked = asked.withColumn("folded", F.lower("unit")).join(known, ["kind", "folded"], "left")
    asked = checkpointed(asked.select("kind", "unit", F.col("gender").alias("own"), F.coalesce(F.nullif("gender", F.lit("")), "settled", F.lit("")).alias("gender")))
    drawn = asked.select("kind", "gender", "unit").distinct()
    drawn = drawn.withColumn("draw", F.lit(0)).withColumn("surrogate", F.lit(None).cast("string")).withColumn("again", F.lit(True))
    for _ in range(DRAWS):
        drawn = checkpointed(drawn.withColumn("surrogate", F.when(F.col("again"), _draw(key)).otherwise(F.col("surrogate"))).drop("again"))
        folded = F.lower("unit")
        name = F.struct(folded.alias("name"), F.col("gender"))
        first = drawn.groupBy("kind", F.lower("surrogate").alias("drawn")).agg(F.min(F.struct("draw", name.alias("name"))).alias("first"))
        real = drawn.select("kind", folded.alias("drawn"), F.lit(True).alias("real")).distinct()
        owned = first.join(real, ["kind", "drawn"], "left")
        judged = drawn.withColumn("drawn", F.lower("surrogate")).join(owned, ["kind", "drawn"])
        again = F.coalesce("real", F.lit(False)) | (F.col("first.name") != name)
        judged = judged.select("kind", "unit", "gender", "surrogate", "draw", again.alias("again"))
        judged = checkpointed(judged.withColumn("draw", F.col("draw") + F.col("again").cast("int")))
        if judged.where("again").isEmpty():
            found = asked.join(judged.select("kind", "gender", "unit", "surrogate"), ["kind", "gender", "unit"])
            return found.select("kind", F.col("own").alias("gender"), "unit", "surrogate")
        drawn = judged
    raise ValueError(f"units are left that share a surrogate after {DRAWS} draws")


def replace_pii(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with its texts' personal data replaced, and a last column ``n_entities``.

    Null texts stay null, with no entities; texts without personal data stay as they are, and so does what no pattern finds,
    such as names that have a form of address nowhere in their text. Repeated rows and texts are replaced alike, and texts
    of any length as wholes; ids play no part. An empty table gives an empty one. The other columns of ``df`` are kept, a column
    ``n_entities`` of its own excepted.
    """
    text = F.col("_text")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "n_entities"]).alias("_row"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_hash", F.sha2(F.coalesce(text, F.lit("")), 256))

    def found(entities: Column, names: Column) -> Column:
        every = F.when(F.size(names) == 0, entities).otherwise(F.regexp_extract_all(text, _pattern(names), F.lit(0)))
        return F.transform(every, lambda e, i: F.struct(i.alias("at"), e.alias("entity"), names.alias("names")))

    # one generator, so that the pattern is looked for once; no filter, which would be moved to the scan with it
    entities = rows.select("_hash", F.inline(let(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda e: let(_names(e), lambda n: found(e, n)))))
    entities = checkpointed(entities.groupBy("_hash", "at").agg(F.first("entity").alias("entity"), F.first("names").alias("names")))  # once for equal texts
    units = entities.select("_hash", "at", F.posexplode(_units(F.col("entity"), F.col("names"))).alias("nth", "u")).select("_hash", "at", "nth", "u.*")
    named = units.join(surrogates(units, key), ["kind", "gender", "unit"], "left")
    part = F.concat(F.coalesce("surrogate", "unit"), F.col("sep"))
    whole = lambda x, order: F.transform(F.array_sort(F.collect_list(F.struct(order, x.alias("x")))), lambda s: s["x"])
    new = named.groupBy("_hash", "at").agg(F.array_join(whole(part, "nth"), "").alias("new"))
    new = new.groupBy("_hash").agg(whole(F.col("new"), "at").alias("_new"))
    own = entities.where("at = 0").select("_hash", F.col("names").alias("_names"))
    new = checkpointed(new.join(own, "_hash"))
    joined = rows.join(new, "_hash", "left")
    filled = lambda pieces: F.array_join(F.zip_with(pieces, F.col("_new"), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    out = (
        F.when(F.col("_new").isNull(), text)
        .when(F.size("_names") == 0, filled(F.split(text, PATTERN, -1)))
        .otherwise(filled(F.split(text, _pattern(F.col("_names")), -1)))
    )
    columns = [out.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in df.columns if c != "n_entities"]
    return joined.select(*columns, F.coalesce(F.size("_new"), F.lit(0)).alias("n_entities"))
