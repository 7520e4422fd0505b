"""String functions as Column expressions: no Python runs per row."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: letters spelt out before accents are dropped
SPELT = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "å": "aa", "æ": "ae", "ø": "oe", "œ": "oe"}
SPELT_IN_NAMES = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "é": "e", "è": "e", "ç": "c"}
# ---- fixed values: marks that repeat the line above
DITTO = ('"', "", "=", "-", "„", "—", ".")
# ---- fixed values: abbreviations of place names
ABBREVIATIONS = (
    ("a d o", "an der oder"), ("a d s", "an der saale"), ("a d h", "an der havel"), ("a d l", "an der lahn"), ("a m", "am main"),
    ("a rh", "am rhein"), ("a n", "am neckar"), ("i pr", "in preussen"), ("i b", "im breisgau"), ("i schles", "in schlesien"),
    ("i schl", "in schlesien"), ("i w", "in westfalen"), ("i bay", "in bayern"), ("i th", "in thueringen"), ("i hann", "in hannover"),
    ("i sa", "in sachsen"), ("st", "sankt"), ("vorm wald", "vorm wald"),
)
# ---- fixed values: spelling rules, in the order in which they apply
SPELLING = (
    (r"\b(\w{4,}?)iensis\b", "$1"), (r"\b(\w{4,}?)ensis\b", "$1"), (r"\b(\w{4,}?)ensium\b", "$1"), (r"\b(\w{4,}?)anus\b", "$1"),
    (r"\b(\w{4,}?)inus\b", "$1"), ("th", "t"), (r"\bc([aouhkqrl])", "k$1"), ("c([aouk])", "k$1"), (r"\bzw?ey", "zwei"),
    ("ey([a-z])", "ei$1"), (r"\bmayn", "main"), ("y", "i"), ("ii+", "i"), ("tz", "z"), ("ck", "k"), (r"dt\b", "t"), ("ph", "f"),
    (r"(\w{3,}?)ischen\b", "$1en"), *((2 * c, c) for c in "bdfgklmnprst"), ("ss", "s"), (r"\s+", " "),
)
# ---- fixed values: words before a place that say what it is
LEADING = (
    "herzogtum", "herzogt", "herz", "hzgt", "grosherzogtum", "grossherzogtum",
    "grossherzogt", "grossherz", "grossh", "ghzt", "erzherzogtum", "kurfuerstentum",
    "kurfuerst", "fuerstentum", "furstentum", "fuerstent", "fuerstl", "fstm",
    "koenigreich", "konigreich", "koenigr", "kgr", "grafschaft", "landgrafschaft",
    "markgrafschaft", "gft", "reichsstadt", "freie reichsstadt", "freie stadt", "provinz",
    "prov", "kreis", "kr", "amt", "bistum", "erzbistum",
    "republik", "freistaat", "departement", "dept", "dep", "canton",
    "kanton", "cant", "kant", "anhalt", "anh", "mecklenburg",
    "mecklb", "meckl", "schwarzburg", "schwarzb", "sachsen", "saechs",
)
LEADING_PREPOSITIONS = ("in der", "in dem", "aus dem", "aus der", "im", "in", "aus", "bei", "zu", "von")
SPLITTING = ("an der", r"a\s*d", "am", r"a\s*m", "ob dem", "unter dem", "vor dem", "im", "in", "bei", "b")
# ---- fixed values: surname particles, in the order in which they are tried
PARTICLES = ("von der", "von dem", "vom", "von", "van der", "van den", "van", "zu", "zur", "zum", "de la", "de", "di", "du", "af", "auf dem")

LETTER = r"[^\p{L}\p{N}_\s]"


def _accents() -> tuple[str, str]:
    """Letters that compatibility decomposition turns into one plain letter, and those letters."""
    pairs = []
    for c in map(chr, [*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            pairs.append((c, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def let(value: Column, use) -> Column:
    """use(value), with value computed once for each row however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def drop_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"[̀-ͯ]", "")


def _spelt(c: Column, table: dict[str, str], upper: bool = True) -> Column:
    for a, b in table.items():
        c = F.replace(c, F.lit(a), F.lit(b))
        if upper and a.upper() != a and len(a.upper()) == 1:
            c = F.replace(c, F.lit(a.upper()), F.lit(b))
    return c


def fold(c: Column) -> Column:
    """Lower case, umlauts spelt out, no accents, hyphens as blanks, no other punctuation, single blanks."""
    c = F.lower(drop_accents(_spelt(strip(c), SPELT)))
    return squeeze(F.regexp_replace(F.regexp_replace(c, "[-/_]", " "), LETTER, ""))


def fold_name(c: Column) -> Column:
    """Lower case, umlauts spelt out, no accents; punctuation stays."""
    return drop_accents(_spelt(F.lower(c), SPELT_IN_NAMES, upper=False))


def rewritten(c: Column, rules) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), rules, c)


def expand_abbreviations(c: Column) -> Column:
    """of a folded place name."""
    return squeeze(rewritten(c, [(r"\b" + a.replace(" ", r"\s+") + r"\b", b) for a, b in ABBREVIATIONS]))


def modernize(c: Column) -> Column:
    """Old spellings of a folded place name as modern ones."""
    return squeeze(rewritten(c, SPELLING))


def modern_word(word: str) -> str:
    """modernize() of one constant."""
    for pattern, to in SPELLING:
        word = re.sub(pattern, to.replace("$1", r"\1"), word)
    return " ".join(word.split())


def _leading() -> str:
    words = {modern_word(w) for w in LEADING}
    return "^(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")\s+"


def strip_qualifiers(c: Column) -> Column:
    """struct(core, hint): a modernised place name without what stands around it, and that, or null."""
    comma = r"^([^,]+),\s*(.+)$"
    inner = r"\s+(?:" + "|".join(SPLITTING) + r")\s+(.+)$"
    prepositions = "^(?:" + "|".join(LEADING_PREPOSITIONS) + r")\s+"

    def split(x: Column) -> Column:
        two = x.rlike(comma)
        head = F.when(two, strip(F.regexp_extract(x, comma, 1))).otherwise(x)
        tail = F.when(two, null_if_empty(strip(F.regexp_extract(x, comma, 2))))
        return let(F.struct(F.regexp_replace(head, prepositions, "").alias("s"), tail.alias("tail")), lambda p: lead(p["s"], p["tail"]))

    def lead(s: Column, tail: Column) -> Column:
        kind = null_if_empty(strip(F.regexp_extract(s, _leading(), 0)))
        return let(F.struct(F.regexp_replace(s, _leading(), "").alias("s"), kind.alias("kind")), lambda p: where(p["s"], p["kind"], tail))

    def where(s: Column, kind: Column, tail: Column) -> Column:
        place = null_if_empty(strip(F.regexp_extract(s, inner, 1)))
        hint = null_if_empty(F.concat_ws(" ", tail, kind, place))
        return F.struct(strip(F.regexp_replace(s, inner, "")).alias("core"), hint.alias("hint"))

    return F.when(c.isNotNull(), let(c, split))


# ---------------------------------------------------------------- phonetic codes


def _coded(letters: Column, at_end_hard: bool, x_first: Column) -> Column:
    """The Cologne code of lower-case a-z. at_end_hard: whether d and t at the end have the code of d and t."""
    def one(each: Column, c: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(each, i - 1)).otherwise("")
        after = F.coalesce(F.get(each, i + 1), F.lit(""))
        sibilant = after.isin("c", "s", "z")
        soft = sibilant if at_end_hard else (sibilant | (after == ""))
        hard_first = after.isin(*"ahkloqrux") if at_end_hard else (after.isin(*"ahkloqrux") | (after == ""))
        hard_later = after.isin(*"ahkoqux") if at_end_hard else (after.isin(*"ahkoqux") | (after == ""))
        return (
            F.when(c.isin(*"aeijouy"), "0").when(c == "b", "1").when(c == "p", F.when(after == "h", "3").otherwise("1"))
            .when(c.isin("d", "t"), F.when(soft, "8").otherwise("2")).when(c.isin(*"fvw"), "3").when(c.isin(*"gkq"), "4")
            .when(c == "c", F.when(i == 0, F.when(hard_first, "4").otherwise("8")).when(before.isin("s", "z"), "8").when(hard_later, "4").otherwise("8"))
            .when(c == "x", F.when(before.isin("c", "k", "q") | (x_first & (before == "")), "8").otherwise("48"))
            .when(c == "l", "5").when(c.isin("m", "n"), "6").when(c == "r", "7").when(c.isin("s", "z"), "8").otherwise("")
        )

    codes = let(F.split(letters, ""), lambda each: F.array_join(F.transform(each, lambda c, i: one(each, c, i)), ""))
    return let(F.regexp_replace(codes, r"(.)\1+", "$1"), lambda flat: F.concat(F.substring(flat, 1, 1), F.replace(F.substring(flat, 2, 1 << 20), F.lit("0"), F.lit(""))))


def phonetic_word(c: Column) -> Column:
    """The code of one word of a place name: umlauts as plain vowels; a final d, t or c and an initial x as
    if a sibilant stood beside them."""
    plain = F.replace(F.translate(F.lower(c), "äöüéè", "aouee"), F.lit("ß"), F.lit("ss"))
    return _coded(F.regexp_replace(drop_accents(plain), "[^a-z]", ""), at_end_hard=False, x_first=F.lit(True))


def phonetic_key(c: Column) -> Column:
    """The codes of all words, joined by hyphens."""
    return F.array_join(F.filter(F.transform(F.split(squeeze(c), " "), phonetic_word), lambda x: x != ""), "-")


def phonetic_name(c: Column) -> Column:
    """The code of a surname, null for none; umlauts are spelt out first."""
    return null_if_empty(_coded(F.regexp_replace(fold_name(c), "[^a-z]", ""), at_end_hard=True, x_first=F.lit(False)))


def ladder(df: DataFrame, column: str) -> DataFrame:
    """column and its keys k_fold, k_expand, k_modern, k_strip, k_phon and hint, a row for each distinct string.

    Keys are made once for each distinct string; join them back on the string."""
    from .. import cut

    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    out = distinct.withColumn("k_fold", fold(F.col(column))).withColumn("k_expand", expand_abbreviations(F.col("k_fold")))
    out = cut(out.withColumn("k_modern", modernize(F.col("k_expand")))).withColumn("_s", strip_qualifiers(F.col("k_modern")))
    out = out.withColumns({"k_strip": F.col("_s.core"), "hint": F.col("_s.hint")}).drop("_s").withColumn("k_phon", phonetic_key(F.col("k_strip")))
    return cut(out).withColumns({k: null_if_empty(F.col(k)) for k in ("k_fold", "k_expand", "k_modern", "k_strip", "k_phon")})


# ---------------------------------------------------------------- similarity


def jaro_winkler(a: Column, b: Column, boost: float = 0.1, floor: float = 0.7) -> Column:
    """Jaro-Winkler similarity of the UTF-8 bytes: transpositions halved downwards, the common prefix
    (of four bytes at most) counts over ``floor``; 0 if a side is empty, null if one is null."""
    by_bytes = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return let(F.struct(by_bytes(a).alias("s"), by_bytes(b).alias("t")), lambda p: _jaro_winkler(p["s"], p["t"], boost, floor))


def alike(a: Column, b: Column, least: float) -> Column:
    """Whether the Jaro-Winkler similarity of a and b reaches ``least``; most pairs that don't are told by the letters they share alone."""
    by_bytes = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    if least <= 0:
        return jaro_winkler(a, b) >= least
    s, t = by_bytes(a), by_bytes(b)
    n, m = F.length(s), F.length(t)
    # letters of a side that the other one has at all: no more can match
    k = F.least(n - F.length(F.call_function("translate", s, t, F.lit(""))), m - F.length(F.call_function("translate", t, s, F.lit(""))))
    most = (F.try_divide(k, n) + F.try_divide(k, m) + 1) / 3
    prefix = sum((F.substring(s, 1, i) == F.substring(t, 1, i)).cast("int") for i in (1, 2, 3, 4))
    may = (n > 0) & (m > 0) & (most + 0.1 * prefix * (1 - most) >= least - 1e-9)
    return may & (jaro_winkler(a, b) >= least)


def _jaro_winkler(s: Column, t: Column, boost: float, floor: float) -> Column:
    n, m = F.length(s), F.length(t)
    reach = F.greatest(F.floor(F.greatest(n, m) / 2) - 1, F.lit(0)).cast("int")
    used = "Ā"  # no byte

    def step(state: Column, i: Column) -> Column:
        letter = F.substr(s, i, F.lit(1))
        first = F.greatest(i - reach, F.lit(1))
        # where the letter is first found in the window of what is left of t, or 0
        hit = F.call_function("instr", F.substr(state["t"], first, F.least(i + reach, m) - first + 1), letter)
        at = first + hit - 1
        rest = F.concat(F.substr(state["t"], F.lit(1), at - 1), F.lit(used), F.substr(state["t"], at + 1))
        return F.struct(F.when(hit > 0, rest).otherwise(state["t"]).alias("t"), F.when(hit > 0, F.concat(state["m"], letter)).otherwise(state["m"]).alias("m"))

    start = F.struct(t.alias("t"), F.lit("").alias("m"))
    end = F.when((n > 0) & (m > 0), F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step))
    found = F.transform(F.array(end), lambda e: F.struct(
        F.length(e["m"]).cast("double").alias("k"),
        F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length(e["m"]), F.lit(1))), lambda i: F.substr(e["m"], i, F.lit(1)) != F.get(
            F.filter(F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda j: F.when(F.substr(e["t"], j, F.lit(1)) == used, F.substr(t, j, F.lit(1)))), lambda x: x.isNotNull()), i - 1
        ))).alias("off"),
    ))
    jaro = F.get(F.transform(found, lambda f: F.when(f["k"] > 0, (f["k"] / n + f["k"] / m + (f["k"] - F.floor(f["off"] / 2)) / f["k"]) / 3).otherwise(0.0)), F.lit(0))
    same = lambda i: F.substr(s, F.lit(1), F.lit(i)) == F.substr(t, F.lit(1), F.lit(i))
    prefix = F.lit(0)
    for i in (1, 2, 3, 4):
        prefix = F.when((n >= i) & (m >= i) & same(i), i).otherwise(prefix)
    known = let(jaro, lambda j: F.when(j > floor, j + prefix * boost * (1 - j)).otherwise(j))
    return F.when(s.isNull() | t.isNull(), None).when((n == 0) | (m == 0), 0.0).otherwise(known)


# ---------------------------------------------------------------- persons

# ---- fixed values: Latin given names and variants, as vernacular ones
LATIN = {
    "carolus": "karl", "caroli": "karl", "joannes": "johann", "ioannes": "johann", "johannes": "johann", "joannis": "johann", "ioannis": "johann",
    "guilielmus": "wilhelm", "wilhelmus": "wilhelm", "gulielmus": "wilhelm", "franciscus": "franz", "josephus": "joseph", "iosephus": "joseph",
    "henricus": "heinrich", "heinricus": "heinrich", "fridericus": "friedrich", "friedericus": "friedrich", "georgius": "georg",
    "ludovicus": "ludwig", "augustus": "august", "augustinus": "augustin", "christianus": "christian", "antonius": "anton", "jacobus": "jakob",
    "iacobus": "jakob", "petrus": "peter", "paulus": "paul", "martinus": "martin", "nicolaus": "nikolaus", "philippus": "philipp",
    "theodorus": "theodor", "ernestus": "ernst", "adolphus": "adolf", "gustavus": "gustav", "mauritius": "moritz", "sebastianus": "sebastian",
    "bernardus": "bernhard", "conradus": "konrad", "eduardus": "eduard", "ferdinandus": "ferdinand", "gothofredus": "gottfried",
    "hermannus": "hermann", "leopoldus": "leopold", "rudolphus": "rudolf", "stephanus": "stephan", "valentinus": "valentin",
    "vincentius": "vinzenz", "xaverius": "xaver", "aloysius": "alois", "ignatius": "ignaz", "benedictus": "benedikt", "gregorius": "gregor",
    "laurentius": "lorenz", "matthaeus": "matthias", "mathias": "matthias", "michaelis": "michael", "emanuel": "immanuel",
}
VARIANTS = {
    "carl": "karl", "karl": "karl", "carolus": "karl", "joh": "johann", "hans": "johann", "johan": "johann", "friederich": "friedrich",
    "fridrich": "friedrich", "josef": "joseph", "wilh": "wilhelm", "willhelm": "wilhelm", "christoff": "christoph", "kristoph": "christoph",
    "theodor": "theodor", "gottlob": "gottlob", "ludewig": "ludwig", "louis": "ludwig", "andreas": "andreas", "andres": "andreas",
    "ernest": "ernst", "guenther": "gunther", "maximilian": "maximilian", "max": "maximilian",
}


def mapped(c: Column, table: dict[str, str]) -> Column:
    """table[c], or null: the strict form; coalesce it with c for the lenient one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def lenient(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(mapped(c, table), c)


def surname(c: Column) -> Column:
    """struct(particle, name): the name without its particle, double letters single; empty as null."""
    return F.when(c.isNotNull(), let(squeeze(F.regexp_replace(fold_name(c), "[^a-z' -]", " ")), _split_surname))


def _split_surname(s: Column) -> Column:
    found = F.lit("")
    for p in reversed(PARTICLES):
        found = F.when(s.startswith(p + " "), p).otherwise(found)
    rest = lambda f: F.when(f != "", F.substr(s, F.length(f) + 2)).otherwise(s)
    name = lambda f: F.trim(F.regexp_replace(rest(f), r"(.)\1+", "$1"))
    return let(found, lambda f: F.struct(null_if_empty(f).alias("particle"), null_if_empty(name(f)).alias("name")))


def given_tokens(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(fold_name(c), "[^a-z. -]", " "), r"[\s-]+"), lambda t: t != "")


def _short(t: Column) -> Column:
    return t.endswith(".") | (F.length(t) <= 3)


_GIVEN = {**VARIANTS, **{k: VARIANTS.get(v, v) for k, v in LATIN.items()}}


def given_names(c: Column) -> Column:
    """Full given names in one spelling; abbreviated ones are dropped, none is null."""
    full = F.transform(F.filter(given_tokens(c), lambda t: ~_short(t)), lambda t: lenient(t, _GIVEN))
    return F.when(F.size(full) > 0, full)


def has_abbreviation(c: Column) -> Column:
    return F.exists(given_tokens(c), _short)


def initials(c: Column, loose: bool = True) -> Column:
    """First letters of the given names in one spelling; loose: c as k, i and y as j."""
    first = F.array_join(F.transform(given_tokens(c), lambda t: F.substring(F.when(_short(t), t).otherwise(lenient(t, _GIVEN)), 1, 1)), "")
    return null_if_empty(F.translate(first, "ciy", "kjj") if loose else first)


def sorted_letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


# ---- fixed values: titles (with capitals, as nouns have them), particles and their short forms
TITLES = (
    "Fürst", "Fürstin", "Erbprinz", "Prinz", "Prinzessin", "Herzog", "Herzogin", "Markgraf",
    "Markgräfin", "Landgraf", "Landgräfin", "Pfalzgraf", "Pfalzgräfin", "Graf", "Gräfin", "Freiherr",
    "Freifrau", "Freiin", "Baron", "Baronin", "Ritter", "Edler", "Edle",
)
NOBLE_PARTICLES = ("von und zu", "von der", "von dem", "vom", "von", "zur", "zum", "zu")
WORD = r"[\p{L}\p{N}_]"
TITLE = rf"(?<!{WORD})(?:{'|'.join(t + (WORD + '*' if t == 'Erbprinz' else '') for t in TITLES)})(?!{WORD})"
PARTICLE = rf"(?i)(?<!{WORD})(?:{'|'.join(NOBLE_PARTICLES)})(?!{WORD})"
SHORT_PARTICLE = rf"(?<!{WORD})(?:v\.\s?(?:d\.|u\.\s?z\.)?(?={WORD})|z\.(?={WORD}))"


def nobility(first: Column, last: Column, noble: list[str] | None = None, common: list[str] | None = None) -> tuple[Column, Column]:
    """The class of a person by the marks in both names, and whether it is a noble one.

    noble, common: surnames whose class is known, without or in spite of a particle."""
    whole = F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))
    known = lambda names: F.coalesce(last.isin(*names), F.lit(False)) if names else F.lit(False)
    kind = (
        F.when(known(common), "known_commoner_von_exception").when(known(noble), "known_noble_bare_exception").when(whole.rlike(TITLE), "titled_noble")
        .when(whole.rlike(PARTICLE) | whole.rlike(SHORT_PARTICLE), "particle_untitled_ambiguous").otherwise("no_marker_likely_non_noble")
    )
    return kind, kind.isin("titled_noble", "particle_untitled_ambiguous", "known_noble_bare_exception")


def first_part(c: Column) -> Column:
    """Before the first comma, without blanks around."""
    return strip(F.split(c, ",")[0])


def place(hometown: Column, region: Column) -> Column:
    """'hometown, region', or the one that is there."""
    return F.when(hometown.isNotNull() & region.isNotNull(), F.concat(hometown, F.lit(", "), region)).otherwise(F.coalesce(hometown, region))


def contains_case(c: Column, table: list[tuple[str, str]]) -> Column:
    """The label of the first substring of the list that c holds, or null."""
    out = None
    for needle, label in table:
        out = F.when(c.contains(needle), label) if out is None else out.when(c.contains(needle), label)
    return out


def flags(c: Column, groups: dict[str, list[str] | str]) -> dict[str, Column]:
    """A boolean for each group: member of a list, or match of a pattern; null for null."""
    return {k: c.rlike(v) if isinstance(v, str) else c.isin(*v) for k, v in groups.items()}


def resolve_names(df: DataFrame, column: str, names: DataFrame, name: str) -> DataFrame:
    """(column, name) for each part of a free text ("A u. B, C") that has a common prefix with just one name.

    A part and a name agree if one begins with the other and the shorter has four letters or more."""
    split = df.select(column, F.explode(F.split(F.col(column), r"(?i)\s+u\.\s+|\s+und\s+|,|/")).alias("raw")).select(
        column, F.trim(F.regexp_replace(fold(F.col("raw")), r"^ex ac\b\s*", "")).alias("part")
    )
    known = names.select(F.col(name), fold(F.col(name)).alias("known"))
    short = F.least(F.length("part"), F.length("known"))
    hits = split.where(F.length("part") >= 4).join(F.broadcast(known), (F.substring("part", 1, 4) == F.substring("known", 1, 4)) & (F.substr("part", F.lit(1), short) == F.substr("known", F.lit(1), short)))
    return hits.groupBy(column, "part").agg(F.min(name).alias(name), F.count_distinct(name).alias("n")).where("n = 1").select(column, name).distinct()
