"""Normalization and pair rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .options import Normal, Rules

# Legal words, and their Turkish counterparts in ASCII.
LEGAL = "limited ltd llc llp lp plc inc incorporated corp corporation co company gmbh ag kg sa sas sarl srl spa bv nv oy ab as pty pvt aş şti ltdşti".split()
TURKISH_LEGAL = "sanayi san sanayii ticaret tic ve anonim sirketi sirket sti ltdsti limited ltd as ithalat ihracat ith ihr ic dis kollektif koll komandit kom kooperatifi koop ortakligi adi".split()
# Turkish ordinals in ASCII.
ONES = "birinci ikinci ucuncu dorduncu besinci altinci yedinci sekizinci dokuzuncu".split()
TENS = "onuncu yirminci otuzuncu kirkinci ellinci altmisinci yetmisinci sekseninci doksaninci".split()
TEN_PREFIXES = "on yirmi otuz kirk elli altmis yetmis seksen doksan".split()
HUNDREDTH = "yuzuncu"

LONG_LEGAL = [w for w in TURKISH_LEGAL if len(w) >= 6]
SWAPPED = sorted({w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in LONG_LEGAL for i in range(len(w) - 1)})
ORDINALS = [*ONES, *TENS, HUNDREDTH, *[p + o for p in TEN_PREFIXES for o in ONES]]


def lowered(name: Column, turkish: bool) -> Column:
    if not turkish:
        return F.lower(name)
    return F.translate(F.lower(F.translate(name, "Iİ", "ıi")), "çğıöşüâîû̇", "cgiosuaiu")


def levenshtein(a: Column, b: Column) -> Column:
    """Insertions, deletions and substitutions from a to b."""
    return F.levenshtein(a, b)


def levenshtein_bounded(a: Column, b: Column, most: int) -> Column:
    """The distance where it is at most `most`, else -1."""
    return F.levenshtein(a, b, most)


def pair_score(a: Column, b: Column) -> Column:
    """The distance as a share of the longer length; 0 for two empty names."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def suffix_pieces(word: Column) -> Column:
    """Parts between points and commas, runs of single characters joined."""
    dotted = F.btrim(F.regexp_replace(word, "[.,]+", "."), F.lit("."))
    joined = F.regexp_replace(dotted, r"(?<=(?:^|\.)[^.])\.(?=[^.](?:\.|$))", "")
    return F.filter(F.split(joined, r"\."), lambda p: p != "")


def osa_within_one(a: Column, words_long: list[str]) -> Column:
    """Whether one insertion, deletion, substitution or swap of neighbours makes a one of these words."""
    near = F.exists(F.array(*map(F.lit, words_long)), lambda s: F.levenshtein(a, s, 1) >= 0)
    swaps = sorted({w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in words_long for i in range(len(w) - 1)})
    return near | a.isin(swaps)


def osa_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and swaps of neighbours from a to b, no part being edited twice. Of words: the
    table is built in the row, its last two lines at a time."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    x, y = chars(a), chars(b)
    line = F.sequence(F.lit(0), F.size(y))

    def next_line(acc: Column, i: Column) -> Column:
        above, before = acc["last"], acc["earlier"]

        def cell(new: Column, j: Column) -> Column:
            same = F.get(x, i - 1) == F.get(y, j - 1)
            swapped = (i > 1) & (j > 1) & (F.get(x, i - 1) == F.get(y, j - 2)) & (F.get(x, i - 2) == F.get(y, j - 1))
            least = F.least(F.get(above, j) + 1, F.get(new, j - 1) + 1, F.get(above, j - 1) + F.when(same, 0).otherwise(1), F.when(swapped, F.get(before, j - 2) + 1))
            return F.concat(new, F.array(least))

        made = F.when(F.size(y) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(y))), F.array(i), cell)).otherwise(F.array(i))
        return F.struct(above.alias("earlier"), made.alias("last"))

    start = F.struct(line.alias("earlier"), line.alias("last"))
    table = F.aggregate(F.when(F.size(x) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(x)))).otherwise(F.array().cast("array<int>")), start, next_line)
    return F.element_at(table["last"], -1)


def listed(word: Column, turkish: bool) -> Column:
    found = word.isin(LEGAL)
    if turkish:
        found = found | word.isin(TURKISH_LEGAL) | ((F.length(word) >= 6) & osa_within_one(word, LONG_LEGAL))
    return found


def is_legal(word: Column, turkish: bool) -> Column:
    pieces = suffix_pieces(word)
    return listed(F.regexp_replace(word, "[.,]", ""), turkish) | ((F.size(pieces) > 0) & F.forall(pieces, lambda p: listed(p, turkish)))


def stripped(ws: Column, turkish: bool) -> Column:
    """Without legal words at the end; one word stays."""
    keep = F.array_max(F.transform(ws, lambda w, i: F.when(is_legal(w, turkish), 0).otherwise(i + 1)))
    return F.when(F.size(ws) > 0, F.slice(ws, F.lit(1), F.greatest(F.lit(1), keep))).otherwise(ws)


def normalize(name: Column, options: Normal = Normal()) -> Column:
    ws = words(lowered(name, options.turkish))
    if options.strip_suffixes:
        ws = stripped(ws, options.turkish)
    return F.array_join(F.array_sort(ws) if options.token_sort else ws, " ")


def tokens(norm: Column) -> Column:
    """The words of a normalized name, sorted."""
    return F.array_sort(F.filter(F.split(norm, " "), lambda w: w != ""))


def is_ordinal(word: Column) -> Column:
    return word.isin(ORDINALS)


def number_words(norm: Column, turkish: bool) -> Column:
    return F.array_sort(F.filter(F.split(norm, " "), lambda w: w.rlike("[0-9]") | (is_ordinal(w) if turkish else F.lit(False))))


def leftover(a: Column, b: Column) -> Column:
    """Words of a, with repeats, that b lacks; sorted and joined."""
    times = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    mine = F.filter(F.split(a, " "), lambda w: w != "")
    other = F.split(b, " ")
    return F.array_join(F.array_sort(F.flatten(F.transform(F.array_distinct(mine), lambda w: F.array_repeat(w, F.greatest(F.lit(0), times(mine, w) - times(other, w)))))), " ")


def accepted(a: Column, b: Column, rules: Rules) -> Column:
    """The pair rules on two normalized names."""
    out = F.lit(True)
    if rules.numbers_must_match:
        out = out & (number_words(a, rules.turkish) == number_words(b, rules.turkish))
    if rules.word_threshold is not None:
        x, y = leftover(a, b), leftover(b, a)
        longest = F.greatest(F.length(x), F.length(y))
        out = out & ((longest == 0) | (F.levenshtein(x, y) / longest <= F.lit(float(rules.word_threshold))))
    return out


def sketch_bound(a: Column, b: Column, buckets: int = 32) -> Column:
    """A lower bound of the edit distance: half the difference of character counts, over hashed buckets."""
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
    count = lambda s, k: F.size(F.filter(chars(s), lambda c: F.pmod(F.ascii(c), F.lit(buckets)) == k))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(buckets - 1)), F.lit(0), lambda acc, k: acc + F.abs(count(a, k) - count(b, k)))
    return F.ceil(total / 2).cast("int")


SKETCH = ("k0", "k1", "k2")  # the columns of a sketch
_COUNTS, _BITS = 10, 6  # counts in a number, bits of each


def sketch(s: Column) -> list[Column]:
    """Character counts over 30 hashed buckets, each up to 6 in unary, so that the bits in which two sketches differ are no
    more than the counts differ by. A character fills the next bit of its bucket."""
    buckets = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(len(SKETCH) * _COUNTS)))
    shifted = lambda n, by: F.call_function("shiftleft", n, by)

    def one_more(acc: Column, k: Column) -> Column:
        at = _BITS * k
        return acc.bitwiseOR(shifted(acc, F.lit(1)).bitwiseAND(shifted(F.lit((1 << _BITS) - 1).cast("long"), at))).bitwiseOR(shifted(F.lit(1).cast("long"), at))

    part = lambda j: F.transform(F.filter(buckets, lambda k: (k >= j * _COUNTS) & (k < (j + 1) * _COUNTS)), lambda k: k - j * _COUNTS)
    return [F.aggregate(part(j), F.lit(0).cast("long"), one_more).alias(name) for j, name in enumerate(SKETCH)]


def may_match(side: str, other: str, edits: Column) -> Column:
    """Whether the sketches of two names, in columns that begin with side and other, allow so few edits: one edit changes
    the counts by two at most."""
    differ = sum((F.bit_count(F.col(f"{side}{k}").bitwiseXOR(F.col(f"{other}{k}"))) for k in SKETCH), F.lit(0))
    return differ <= 2 * edits
