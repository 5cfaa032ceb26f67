"""Surrogates for personal data, in DataFrame operations only.

Detected entities are e-mail, IPv4 and IPv6 addresses, telephone, card and social security
numbers, and names behind a form of address: any number of name words, with initials,
particles, apostrophes and inner capitals, or in capitals throughout. Cards of other
lengths than sixteen digits count only with a right check digit. Replacements are keyed and keep type
and format:

* an address or number goes through a keyed permutation of all values of its format
  (a Feistel network over its characters or octets), so different entities of one
  format get different surrogates whatever their number. An e-mail keeps its length,
  its places of letters, digits and signs and its top-level domain, and equal domains
  stay equal; an IPv4 address keeps its private network and the length of each octet;
  a number keeps its grouping, its country or issuer digits and whether its check
  digit is right;
* a name is composed of syllables by the keyed hash, in its own script (Latin, Cyrillic,
  Greek or Armenian; any other script gets Latin ones), with an ending of its gender.
  Cyrillic and Greek family names have one entity for both genders and are written in the
  gender of the mention. Drawn names grow by a syllable with each redraw, so there is no
  end of them.

Collision checks: a surrogate that is itself an entity of the corpus, or that another
entity has, is redrawn by the next permutation or longer name until none is left. Only a
format of which the corpus holds more than a quarter of all values is not held to
the first rule (there may be nothing else left); its one permutation keeps all different.

Coreference: equal entities, however they are written, get equal surrogates in the
whole corpus. A given name whose mention shows no gender takes the one that most of its
mentions in the corpus show; only a name that is met with both has a surrogate for each. In a document that names a person behind a form of address, the same
given and family names standing alone, later or earlier, follow their surrogates.

Entities are gathered into one table of distinct values. Each text is cut at its
mentions once and joined again with the replacements, so no replacement is ever
searched in.

Defined results: a null text stays null with no entities; a text without entities
is returned as it is; repeated rows are treated alike; an empty table gives no
rows; extra columns stay as they are, and where one bears a result's name, the result's
gets underscores behind it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, shared_table, small

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
EMAIL = r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}|{_HEX}:(?::{_HEX}){{2,6}})(?![0-9A-Za-z:]|[.][0-9])"
IP = rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9.,-])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9]|[.,-][0-9])"
#: Cards of 13, 14, 15 and 19 digits, by what they begin with; only a right check digit makes a number one.
OTHER_CARD = r"(?<![0-9.,-])(?:3[47][0-9]{2}(?:[0-9]{11}| [0-9]{6} [0-9]{5}|-[0-9]{6}-[0-9]{5})|3(?:0[0-5]|[689][0-9])[0-9](?:[0-9]{10}| [0-9]{6} [0-9]{4}|-[0-9]{6}-[0-9]{4})|4[0-9]{12}|[46][0-9]{18})(?![0-9]|[.,-][0-9])"
SSN = r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|[.-][0-9])"
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9]|[.-][0-9])"
#: Dotted numbers, and national ones that begin with a zero.
HOME_PHONE = r"(?<![0-9.-])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9]|[.-][0-9])|(?<![0-9.,-])0(?:[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}|[1-9](?:(?: [0-9]{2}){4}|(?:\.[0-9]{2}){4})|[0-9]{2,4}[ /-][0-9]{5,8})(?![0-9]|[.,-][0-9])"
#: Forms of address by the gender they show.
MALE = ["Mr", "Mr.", "Herr", "Monsieur", "Señor", "Sr.", "Signor", "г-н", "Господин"]
FEMALE = ["Mrs", "Mrs.", "Ms", "Ms.", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Signora", "г-жа", "Госпожа"]
OTHER = ["Dr", "Dr.", "Prof", "Prof."]
#: A name word: O'Brien, McDonald, Anna-Maria; initials; what joins the parts of a family name.
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)*(?:-\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)*)*"
_INITIAL = r"(?:\p{Lu}[.])+"
_PARTICLE = "(?:van|von|der|den|de|la|las|los|le|du|del|della|di|da|dos|das|ten|ter|zu|zur|bin|ibn|al|el|y)"
_CAPITALS = r"\p{Lu}(?:['’]\p{Lu})?\p{Lu}+(?:-\p{Lu}+)*"


def _titles(*said: str) -> str:
    return "|".join(sorted((t.replace(".", "[.]") for t in said), key=len, reverse=True))


_PART = rf"(?:{_INITIAL} ?)*(?:{_PARTICLE} )*{_WORD}"
_GIVEN_CAPITALS = "ADAM BRUNO CARL DAVID EMIL FELIX GEORG HUGO IVAN JONAS KARL LEON MARTIN NICO OSCAR PAUL ROBERT SIMON THOMAS VICTOR JOHN JAMES ANNA BELLA CLARA DIANA EMMA FLORA GRETA HELEN IRENE JULIA KARLA LAURA MARIA NORA OLGA PAULA ROSA SARA TESSA VERA".replace(" ", "|")
#: In capitals throughout nothing tells a name from the word behind it: one word counts, and more only behind a known given name or initials.
PERSON = (
    rf"(?<![\p{{L}}])(?:(?:{_titles(*MALE, *FEMALE, *OTHER)}) {_PART}(?: {_PART}){{0,4}}"
    rf"|(?:{_titles(*{t.upper() for t in MALE + FEMALE + OTHER})}) (?:{_INITIAL} ?)*(?:(?:{_GIVEN_CAPITALS}) )?{_CAPITALS})(?!\p{{L}})"
)
#: A capitalised word that stands alone and begins no e-mail address; looked at only in texts with a person.
WORD = rf"(?<!\p{{L}}){_WORD}(?!\p{{L}}|[\p{{L}}0-9._%+-]*@)"
#: All kinds in one.
ANY = f"{EMAIL}|{IP}|{IP6}|{CARD}|{OTHER_CARD}|{SSN}|{PHONE}|{HOME_PHONE}|{PERSON}"
#: What a text with any mention must hold; spares the large pattern elsewhere.
HINT = r"@|[0-9]{1,3}\.[0-9]{1,3}\.|[0-9]{4}[ -]?[0-9]{4}|[0-9]-[0-9]|\+[0-9]|0[0-9]{1,4}[ ./-][0-9]{2}|[0-9A-Fa-f]:[0-9A-Fa-f:]*:|" + f"(?:{'|'.join(sorted({x for t in MALE + FEMALE + OTHER for x in (t.rstrip('.'), t.rstrip('.').upper())}))})[.]? "

#: Given names that show a gender behind a form of address that shows none.
GIVEN = {
    "m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nico Oscar Paul Robert Simon Thomas Victor John James Антон Борис Виктор Глеб Денис Егор Иван Кирилл Максим Павел".split(),
    "f": "Anna Bella Clara Diana Emma Flora Greta Helen Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sara Tessa Vera Алла Вера Галина Дарья Елена Инна Лидия Мария Нина Ольга".split(),
}
#: Consonants and vowels of the syllables by script.
SYLLABLES = {
    "latin": ("b d f g h k l m n p r s t v z".split(), "a e i o u".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф".split(), "а е и о у".split()),
    "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ".split(), "α ε ι ο η".split()),
    "armenian": ("բ գ դ զ կ լ մ ն պ ր ս տ վ ֆ շ".split(), "ա ե ի ո է".split()),
}
#: Endings by script and part (male, female, neutral, family).
ENDINGS = {
    "latin m": "o us an er in ard on el".split(), "latin f": "a ia ina ella ette ise anne ora".split(), "latin -": "y is en e".split(), "latin family": "man son berg ley ner sen wick ford".split(),
    "cyrillic m": "ан ор ин ей ил ат".split(), "cyrillic f": "а ия ета ара оня уся".split(), "cyrillic -": "е и".split(), "cyrillic family": "ов ев ин".split(),
    "greek m": "ος ης ας".split(), "greek f": "α η ω".split(), "greek -": "ι υ".split(), "greek family": "ίδης άκης".split(),
    "armenian m": "են ան ակ".split(), "armenian f": "ուհի ինե".split(), "armenian -": "ո ի".split(), "armenian family": "յան ունի".split(),
}
PERSONAL = list(ENDINGS)
#: Characters before the ending: so many syllables and a consonant at the first draw, one more at each redraw.
FIRST_SYLLABLES, ROUNDS = 3, 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email").when(m.contains(":"), "ip6").when(m.rlike(r"^\p{L}"), F.when(m.contains(" "), "person").otherwise("word")).when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(m.rlike(r"^[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), "card").when(m.rlike(f"^{OTHER_CARD}$"), "card").otherwise("phone")
    )


def _gender(title: Column, given: Column) -> Column:
    said = F.when(F.lower(title).isin([t.lower() for t in MALE]), "m").when(F.lower(title).isin([t.lower() for t in FEMALE]), "f")
    for g, names in GIVEN.items():
        said = said.when(F.lower(given).isin([n.lower() for n in names]), g)
    return said.otherwise("-")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").when(word.rlike(r"^\p{IsArmenian}"), "armenian").otherwise("latin")


def _one_family(script: Column, gender: Column, low: Column) -> Column:
    """The masculine form of a family name that is written in a feminine one."""
    shown = gender != "m"
    return (
        F.when(shown & (script == "cyrillic") & low.rlike("(ская|цкая)$"), F.regexp_replace(low, "ая$", "ий"))
        .when((script == "cyrillic") & ((shown & low.rlike("(ова|ева|ёва)$")) | ((gender == "f") & low.rlike("(ина|ына)$"))), F.regexp_replace(low, "а$", ""))
        .when(shown & (script == "greek") & low.rlike("(ίδη|άκη)$"), F.concat(low, F.lit("ς")))
        .otherwise(low)
    )


def _tokens(m: Column) -> Column:
    """The words of a name's mention; initials stand apart."""
    return F.split(F.regexp_replace(m, r"(?<=\p{Lu}[.])(?=\p{Lu}\p{L})", " "), " ")


def _is_name(word: Column) -> Column:
    return word.rlike(rf"^(?:{_WORD}|{_CAPITALS})$")


def parts(m: Column) -> Column:
    """A mention's entities: array of (kind, norm, word, feminine). A name has one for each of its name words, any other mention has one; the last name word is the family's."""

    def entity(kind: Column, norm: Column, word: Column, feminine: Column) -> Column:
        return F.struct(kind.alias("kind"), norm.alias("norm"), word.alias("word"), feminine.alias("feminine"))

    kind, words = _kind(m), _tokens(m)
    names = F.filter(F.slice(words, 2, 99), _is_name)

    def told(names: Column) -> Column:
        family = F.element_at(names, -1)
        gender = _gender(F.get(words, F.lit(0)), F.when(F.size(names) > 1, names[0]))
        one = _one_family(_script(family), gender, F.lower(family))

        def each(w: Column, i: Column) -> Column:
            last = entity(F.concat(_script(w), F.lit(" family")), one, w, (gender == "f") | (one != F.lower(w)))
            return F.when(i == F.size(names) - 1, last).otherwise(entity(F.concat(_script(w), F.lit(" "), gender), F.lower(w), w, F.lit(False)))

        return F.transform(names, each)

    norm = F.when(kind.isin("email", "ip6"), F.lower(m)).when(kind == "ip", m).otherwise(_digits(m))
    # A number after + has its country in it; one without is another number.
    norm = F.when((kind == "phone") & m.startswith("+"), F.concat(F.lit("+"), norm)).otherwise(norm)
    return F.when(kind == "person", _let(names, told)).otherwise(F.array(entity(kind, norm, m, F.lit(False))))


def _is_entity(m: Column) -> Column:
    """Cards of unusual lengths need a right check digit."""
    return ~m.rlike(f"^{OTHER_CARD}$") | (_luhn(_digits(m)) % 10 == 0)


def _stream(*what: Column) -> Column:
    """64 keyed numbers of 16 bits, as hex digits."""
    return _let(F.concat_ws("|", *what), lambda seed: F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{k}")), 256) for k in range(4)]))


def _number(stream: Column, i: Column | int) -> Column:
    """The i-th number of a stream, around its end."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64 * 4 + 1
    return F.conv(F.substring(stream, at, F.lit(4)), 16, 10).cast("int")


def _cell(v: Column, low: Column, size: Column) -> Column:
    """A place of a format: its value v in [0, size), written as low + v."""
    return F.struct(v.cast("int").alias("v"), low.cast("int").alias("low"), size.cast("int").alias("size"))


def _cells(text: Column, keep: Column) -> Column:
    """The places of a text: digits and small letters behind the first `keep` characters vary, all else stays."""

    def one(c: Column, i: Column) -> Column:
        code = F.ascii(c)
        fixed = _cell(F.lit(0), code, F.lit(1))
        letter = F.when(c.rlike("[a-z]"), _cell(code - 97, F.lit(97), F.lit(26))).otherwise(_cell(code % 26, F.lit(97), F.lit(26)))  # another script's letters become small Latin ones
        return F.when(i < keep, fixed).when(c.rlike("[0-9]"), _cell(code - 48, F.lit(48), F.lit(10))).when(c.rlike(r"\p{Ll}|\p{Lo}|\p{Lm}"), letter).otherwise(fixed)

    return F.transform(F.split(text, ""), one)


def _hex_cells(text: Column) -> Column:
    """The places of hexadecimal digits: figures and letters vary among themselves, colons stay."""

    def one(c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c.rlike("[0-9]"), _cell(code - 48, F.lit(48), F.lit(10))).when(c.rlike("[a-f]"), _cell(code - 97, F.lit(97), F.lit(6))).otherwise(_cell(F.lit(0), code, F.lit(1)))

    return F.transform(F.split(text, ""), one)


def _permuted(cells: Column, *seed: Column) -> Column:
    """A keyed permutation of all values of a format: even and odd places shift each other in turn."""

    def step(now: Column, r: int) -> Column:
        def shifted(x: Column) -> Column:
            others = F.concat_ws(",", F.transform(F.filter(x, lambda c, i: i % 2 != r % 2), lambda c: c["v"].cast("string")))
            return _let(_stream(*seed, F.lit(str(r)), others), lambda s: F.transform(x, lambda c, i: F.when(i % 2 == r % 2, _cell((c["v"] + _number(s, i)) % c["size"], c["low"], c["size"])).otherwise(c)))

        return _let(now, shifted)

    for r in range(ROUNDS):
        cells = step(cells, r)
    return cells


def _spelled(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda c: F.char(c["low"] + c["v"])), "")


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 in a number with a right check digit."""
    def add(c: Column, i: Column) -> Column:
        d = F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))
        return F.when((F.length(digits) - 1 - i) % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), add), F.lit(0), lambda acc, x: acc + x)


def _octets(ip: Column) -> Column:
    """The places of an IPv4 address. Private networks and the first octets that hold some stay as they are."""
    held = F.when(ip.rlike(r"^(192|169|172)\."), 2).when(ip.rlike(r"^(10|127|0)\."), 1).otherwise(0)

    def one(o: Column, i: Column) -> Column:
        v = o.cast("int")
        # The first octet's 100 to 255 without 127, 169, 172 and 192 are numbered through.
        ahead = sum((v > x).cast("int") for x in (127, 169, 172, 192))
        first = F.when(v < 10, _cell(v - 1, F.lit(1), F.lit(9))).when(v < 100, _cell(v - 11, F.lit(11), F.lit(89))).otherwise(_cell(v - 100 - ahead, F.lit(100), F.lit(152)))
        other = F.when(v < 10, _cell(v, F.lit(0), F.lit(10))).when(v < 100, _cell(v - 10, F.lit(10), F.lit(90))).otherwise(_cell(v - 100, F.lit(100), F.lit(156)))
        return F.when(i < held, _cell(F.lit(0), v, F.lit(1))).when(i == 0, first).otherwise(other)

    return F.transform(F.split(ip, r"\."), one)


def _dotted(cells: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        v = c["low"] + c["v"]
        for x in (127, 169, 172, 192):
            v = F.when((i == 0) & (c["size"] == 152) & (v >= x), v + 1).otherwise(v)
        return v.cast("string")

    return F.array_join(F.transform(cells, one), ".")


def _formed() -> Column:
    """The places of an entity (null for names); their fixed part and sizes are its format."""
    kind, norm = F.col("kind"), F.col("norm")
    domain = F.length(norm) - F.length(F.substring_index(norm, ".", -1))  # letters behind the last point stay
    country = F.when(norm.startswith("+1"), 2).when(norm.startswith("+"), 3).otherwise(0)
    return (
        F.when(kind == "ip", _octets(norm)).when(kind == "ip6", _hex_cells(norm)).when(kind == "card", _cells(F.substring(norm, F.lit(1), F.length(norm) - 1), F.lit(1))).when(kind == "phone", _cells(norm, country)).when(kind == "ssn", _cells(norm, F.lit(0)))
        .when(kind == "email", F.concat(_cells(F.substring(norm, F.lit(1), domain), F.lit(0)), _cells(F.substring(norm, domain + 1, F.length(norm)), F.lit(64))))
    )


def _composed(name: str) -> Callable[[Column], Column]:
    """A name of this script and part from a stream."""
    consonants, vowels = (F.array(*map(F.lit, x)) for x in SYLLABLES[name.split()[0]])
    endings = F.array(*map(F.lit, ENDINGS[name]))

    def whole(s: Column) -> Column:
        def choose(pool: Column, i: Column | int) -> Column:
            return F.element_at(pool, _number(s, i) % F.size(pool) + 1)

        body = F.transform(F.sequence(F.lit(1), F.lit(FIRST_SYLLABLES) + F.col("attempt")), lambda k: F.concat(choose(consonants, k * 2), choose(vowels, k * 2 + 1)))
        return F.initcap(F.concat(F.array_join(body, ""), choose(consonants, 0), choose(endings, 1)))

    return whole


def _drawn(key: str) -> Column:
    """The surrogate of (kind, norm) at its attempt."""
    kind, norm, attempt = F.col("kind"), F.col("norm"), F.col("attempt").cast("string")
    seed = (F.lit(key), kind, attempt)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(tld))
    email = F.concat(_spelled(_permuted(_cells(local, F.lit(0)), *seed, domain)), F.lit("@"), _spelled(_permuted(_cells(host, F.lit(0)), F.lit(key), F.lit("host"), tld)), tld)
    body = _spelled(_permuted(_cells(F.substring(norm, F.lit(1), F.length(norm) - 1), F.lit(1)), *seed))
    # The last digit stays as far from the right one as it was.
    card = _let(body, lambda b: F.concat(b, ((20 + _luhn(norm) - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    country = F.when(norm.startswith("+1"), 2).when(norm.startswith("+"), 3).otherwise(0)
    out = F.when(kind == "email", email).when(kind == "ip", _dotted(_permuted(_octets(norm), *seed))).when(kind == "ip6", _spelled(_permuted(_hex_cells(norm), *seed))).when(kind == "card", card)
    out = out.when(kind == "phone", _spelled(_permuted(_cells(norm, country), *seed, F.length(norm).cast("string")))).when(kind == "ssn", _spelled(_permuted(_cells(norm, F.lit(0)), *seed)))
    for name in PERSONAL:
        out = out.when(kind == name, _let(_stream(*seed, norm), _composed(name)))
    return out


def surrogates(spark: SparkSession, entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, surrogate for distinct entities (kind, norm); no two share one, and none is an entity (see the module's rule for crowded formats)."""
    space = F.when(F.col("kind").isin(PERSONAL), "person").otherwise(F.col("kind"))
    fixed = lambda c: F.when(c["size"] == 1, c["low"]).otherwise(-c["size"]).cast("string")
    entities = entities.withColumn("space", space).withColumn("cells", _formed())
    entities = entities.select("kind", "norm", "space", F.concat_ws(",", "kind", F.transform("cells", fixed)).alias("format"), F.aggregate("cells", F.lit(0.0), lambda acc, c: acc + F.log10(c["size"].cast("double"))).alias("room"))
    entities = shared_table(spark, entities, "entities")
    crowded = entities.where("room is not null").groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.first("room").alias("room")).where(F.log10(F.col("n") * 4) > F.col("room")).select("format", F.lit(True).alias("crowded"))
    crowded = shared_table(spark, crowded, "crowded-formats")
    pending = entities.join(small(crowded), "format", "left").select("kind", "norm", "space", F.coalesce("crowded", F.lit(False)).alias("crowded"), F.lit(0).alias("attempt"))
    known = entities.select("space", F.col("norm").alias("low"), F.lit(True).alias("entity")).distinct()
    done: DataFrame | None = None
    while True:
        drawn = shared_table(spark, pending.withColumn("surrogate", _drawn(key)).withColumn("low", F.lower("surrogate")), "drawn")
        # Values are as many as entities or more, so these groups are small.
        best = drawn.groupBy("space", "low").agg(F.min(F.struct(~F.col("crowded"), "kind", "norm", "surrogate")).alias("b")).select("space", "low", "b.*").toDF("space", "low", "free", "kind", "norm", "surrogate")
        good = best.join(known, ["space", "low"], "left").where("not free or entity is null").drop("entity", "free")
        if done is not None:
            good = good.join(done.select("space", "low"), ["space", "low"], "left_anti")
        good = shared_table(spark, good, "accepted")
        done = good if done is None else done.unionByName(good)
        pending = drawn.join(good.select("kind", "norm"), ["kind", "norm"], "left_anti").select("kind", "norm", "space", "crowded", (F.col("attempt") + 1).alias("attempt"))
        pending = shared_table(spark, pending, "pending")
        if pending.isEmpty():
            return done.select("kind", "norm", "surrogate")


def _form(kind: Column, feminine: Column, surrogate: Column) -> Column:
    """A name's surrogate in the gender of its mention."""
    return F.when(feminine & (kind == "cyrillic family"), F.concat(surrogate, F.lit("а"))).when(feminine & (kind == "greek family"), F.regexp_replace(surrogate, "ς$", "")).otherwise(surrogate)


def _initials(key: str) -> tuple[str, str]:
    """Two alphabets, plain and in a keyed order: what initials become."""
    import hashlib

    plain = "".join(chr(c) for a, z in ((65, 90), (0x0410, 0x042F), (0x0391, 0x03A9), (0x0531, 0x0556)) for c in range(a, z + 1) if c != 0x03A2)
    blocks = [[c for c in plain if a <= ord(c) <= z] for a, z in ((65, 90), (0x0410, 0x042F), (0x0391, 0x03A9), (0x0531, 0x0556))]
    # Sorted by a keyed hash, then moved on by one along that order, so that no letter stays.
    turned = {}
    for block in blocks:
        order = sorted(block, key=lambda c: hashlib.sha256(f"{key}|{c}".encode()).digest())
        turned |= dict(zip(order, [*order[1:], order[0]], strict=True))
    return plain, "".join(turned[c] for c in plain)


def _written(m: Column, given: Column, key: str) -> Column:
    """The replacement of a mention from its entities' surrogates, in the mention's own format and case."""
    kind, new = _kind(m), given[0]
    chars = F.split(m, "")
    digits = _digits(new)
    # The n-th digit of the mention becomes the n-th digit of the surrogate.
    number = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.zip_with(chars, F.split(new, ""), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")
    plain, turned = _initials(key)

    def said(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            name = F.get(given, F.size(F.filter(F.slice(words, F.lit(2), i), _is_name)) - 1)
            name = F.when(w.rlike(rf"^{_CAPITALS}$"), F.upper(name)).otherwise(name)
            return F.when(i == 0, w).when(_is_name(w), name).when(w.rlike(rf"^{_INITIAL}$"), F.translate(w, plain, turned)).otherwise(w)

        return F.array_join(F.transform(words, one), " ")

    person = _let(_tokens(m), said)
    # Initials that stood close to the name behind them do so again.
    person = F.when(m.rlike(r"\p{Lu}[.]\p{Lu}\p{L}"), F.regexp_replace(person, r"(?<=\p{Lu}[.]) (?=\p{Lu}\p{L})", "")).otherwise(person)
    return F.when(kind == "person", person).when(kind.isin("email", "ip6"), cased).when(kind == "ip", new).otherwise(number)


def _alone() -> Column:
    """(word, new) of a name standing alone: as it was written, and a family name's form of the other gender."""
    kind, word, plain = F.col("kind"), F.col("word"), F.col("surrogate")
    pair = lambda w, new: F.struct(w.alias("word"), new.alias("new"))
    other = F.when((kind == "cyrillic family") & word.rlike("(ов|ев|ёв|ин|ын)$"), pair(F.concat(word, F.lit("а")), F.concat(plain, F.lit("а"))))
    other = other.when((kind == "cyrillic family") & word.rlike("(ова|ева|ёва|ина|ына)$") & (F.col("norm") != F.lower(word)), pair(F.regexp_replace(word, "а$", ""), plain))
    return F.filter(F.array(pair(word, F.col("form")), other), lambda x: x.isNotNull())


def _gendered(said: DataFrame) -> DataFrame:
    """A given name whose mention shows no gender takes the one that most of its mentions in the corpus show (of equals the male). Counts are made in the corpus, not per key in one task."""
    script = F.substring_index("kind", " ", 1)
    shown = said.where(F.col("kind").rlike(" [mf]$")).groupBy(script.alias("script"), "norm", F.col("kind").alias("shown")).agg(F.count(F.lit(1)).alias("n"))
    shown = shown.groupBy("script", "norm").agg(F.max_by("shown", F.struct("n", "shown")).alias("shown"))
    neutral = F.col("kind").endswith(" -")
    return said.where(neutral).select("kind", "norm").distinct().withColumn("script", script).join(shown, ["script", "norm"]).select("kind", "norm", "shown")


def replace(spark: SparkSession, docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in text, the number of mentions of each kind, and n_bare names that stand alone."""
    ident, held, named, listed = free(docs.columns, "_doc", "_map", "_named", "_kinds")
    results = free(docs.columns, *[f"n_{k}" for k in ("email", "ip", "phone", "card", "ssn", "person", "bare")])
    whole = docs.withColumn("text", F.col("text").cast("string"))
    mentions = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    doc = F.xxhash64(F.col("doc_id"), F.col("text"))
    said = whole.select(doc.alias("_doc"), mentions.alias("m")).where(F.size("m") > 0).select("_doc", F.explode(F.array_distinct("m")).alias("m")).distinct().where(_is_entity(F.col("m")))
    said = said.select("_doc", "m", F.posexplode(parts(F.col("m"))).alias("nth", "e")).select("_doc", "m", "nth", "e.*")
    said = shared_table(spark, said, "mentions-read")
    told = shared_table(spark, _gendered(said), "mentions-gendered")
    said = shared_table(spark, said.join(small(told), ["kind", "norm"], "left").withColumn("kind", F.coalesce("shown", "kind")).drop("shown"), "mentions")
    table = surrogates(spark, said.select("kind", "norm").distinct(), key)
    drawn = said.join(small(table), ["kind", "norm"]).withColumn("form", _form(F.col("kind"), F.col("feminine"), F.col("surrogate")))
    drawn = shared_table(spark, drawn, "mentions-drawn")
    given = F.transform(F.array_sort(F.collect_list(F.struct("nth", "form"))), lambda x: x["form"])
    new = drawn.groupBy("_doc", "m").agg(given.alias("given")).select("_doc", "m", _written(F.col("m"), F.col("given"), key).alias("new"), F.lit(False).alias("alone"))
    alone = drawn.where(F.col("kind").isin(PERSONAL)).select("_doc", (~F.col("kind").endswith("family")).alias("later"), F.inline(_alone()))
    alone = alone.groupBy("_doc", "word").agg(F.min(F.struct("later", "new"))["new"].alias("new")).select("_doc", F.col("word").alias("m"), "new", F.lit(True).alias("alone"))
    maps = new.unionByName(alone).groupBy("_doc").agg(F.map_from_entries(F.collect_list(F.struct("m", "new"))).alias(held), F.max("alone").alias(named)).withColumnRenamed("_doc", ident)
    maps = shared_table(spark, maps, "replacements")
    out = whole.withColumn(ident, doc).join(small(maps), ident, "left")

    def found(pattern: str) -> Column:
        return F.regexp_extract_all("text", F.lit(pattern), F.lit(0))

    def joined(pattern: str) -> Column:
        return F.array_join(F.zip_with(F.split("text", pattern, -1), found(pattern), lambda g, m: F.concat(g, F.coalesce(F.try_element_at(held, m), m, F.lit("")))), "")

    def either(one: Callable[[str], Column], none: Column) -> Column:
        return F.when(F.col(held).isNull(), none).when(F.col(named), one(f"{ANY}|{WORD}")).otherwise(one(ANY))

    kinds = either(lambda p: F.transform(F.filter(found(p), lambda m: F.map_contains_key(held, m)), _kind), F.array().cast("array<string>"))
    cols = [either(joined, F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    out = out.select(*cols, kinds.alias(listed))

    def count(*kinds: str) -> Column:
        return F.size(F.filter(listed, lambda k: k.isin(*kinds))).cast("long")

    counts = [count(k) for k in ("email",)] + [count("ip", "ip6")] + [count(k) for k in ("phone", "card", "ssn", "person", "word")]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[c.alias(n) for c, n in zip(counts, results, strict=True)])
