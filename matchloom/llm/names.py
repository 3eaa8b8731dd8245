"""Variant spellings of people's names, linked by a trie join.

A typed name is normalised and split into tokens, in any script and of any number. One
token is the given name (in full, short or an initial) and the others, in whatever order
they stand, are the family name; where no token is a listed given name, the tokens
together are the name. A name's tokens are kept sorted, so that every order of them is
the same name. Two names are neighbours if all tokens but one agree and that one is
within one edit: the names are sharded by what must then agree, each shard is a trie,
and a Levenshtein automaton of every name is run through it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import discard, materialise

#: Letters that digits and signs stand for.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Letters without a decomposition, as they are written in plain letters.
PLAIN = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ħ": "h", "Ħ": "H", "ı": "i", "ß": "ss", "ẞ": "SS"})
#: Names shorter than this must agree exactly; longer ones may differ by one edit.
FUZZY_FROM = 5
#: Names that a shard's trie holds at most, unless they differ in two letters at one place only.
TRIE = 2_000

_TAG = regex.compile(r"^\s*[\[(<{][^\])>}]*[\])>}]\s*")
_BARS = regex.compile(r"[Il1|\s]*")
_APART = regex.compile(r"[._ ]")
_NUMBER = regex.compile(r"(?<=\p{L})[0-9]+$")
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}@$!]+")
_HUMPS = regex.compile(r"\p{Lu}?[\p{Ll}\p{Lo}\p{Lm}\p{M}0-9@$!]+|[\p{Lu}0-9@$!]+(?!\p{Ll})|\p{Lu}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def plain_letters(text: str) -> str:
    """Without marks on letters, in compatibility form."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", text.translate(PLAIN)) if not unicodedata.combining(c)))


def _letters(part: str) -> str:
    """A word in lower case, digits and signs among its letters read as the letters they
    look like; what still isn't a letter is dropped, and digits at the end if one of them
    looks like none. '' if there is no letter."""
    if not regex.search(r"\p{L}", part):
        return ""
    end = _NUMBER.search(part)
    if end and not set(end.group()) <= LOOKALIKES.keys():
        part = part[: end.start()]
    return _OTHER.sub("", "".join(LOOKALIKES.get(c, c) for c in part.lower()))


def tokens(nickname: str, humps: bool = True) -> list[str]:
    """A nickname's words in lower case, in the order typed. A bracketed tag in front and
    digits behind a separated name are dropped. A name typed without separators is cut
    before capitals (with `humps`). Nothing remains of a name made of bars only (I, l, 1)."""
    s = _TAG.sub("", plain_letters(nickname)).strip()
    if _BARS.fullmatch(s):
        return []
    if _APART.search(s):
        s = _NUMBER.sub("", s)
    words = _WORDS.findall(s)
    if humps and len(words) == 1:
        words = _HUMPS.findall(words[0])
    return [x for x in map(_letters, words) if x]


class Trie:
    """Words by their letters; `near` runs a Levenshtein automaton through it."""

    def __init__(self, words) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, most: int = 1) -> list[tuple[str, int]]:
        """(word of the trie, distance) for all within `most` edits: insertion, deletion,
        substitution, or swap of neighbours. The automaton's state is a row of the
        distance table; a branch ends where no entry of it is within reach."""
        n, out = len(word), []
        first = list(range(n + 1))
        stack = [(node, c, first, None, "") for c, node in self.root.items() if c]
        while stack:
            node, c, row, above, before = stack.pop()
            nxt = [row[0] + 1]
            for i in range(1, n + 1):
                cost = min(nxt[i - 1] + 1, row[i] + 1, row[i - 1] + (word[i - 1] != c))
                if above is not None and i > 1 and word[i - 1] == before and word[i - 2] == c:
                    cost = min(cost, above[i - 2] + 1)
                nxt.append(cost)
            if min(nxt) > most and min(row) > most:
                continue
            if "" in node and nxt[n] <= most:
                out.append((node[""], nxt[n]))
            stack.extend((x, d, nxt, row, c) for d, x in node.items() if d)
        return out


def _halves(df: DataFrame) -> DataFrame:
    """Windows of half the width for rows that have one (i, j): between two words of
    length `n0`, or of n0 and n0 + 1, an edit within the window lies in one of its
    halves, which overlap by a letter as a swap takes two. Outside of the window the
    words agree, which is the key of the row's shard."""
    middle = F.expr("i + (j - i + 2) div 2")
    df = df.withColumn("half", F.explode(F.array(F.struct(F.col("i").alias("i"), middle.alias("j")), F.struct((middle - 1).alias("i"), F.col("j").alias("j")))))
    df = df.select("name", "rest", "word", "n0", F.col("half.i").alias("i"), F.col("half.j").alias("j"))
    left, right = F.expr("substring(word, 1, i)"), F.expr("right(word, n0 - j)")
    return df.withColumn("shard", F.concat_ws("\x1f", "rest", "n0", "i", "j", left, right))


def _run_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, n0, word, name) in the order of shards: a trie for each shard, and
    every word of the shorter length run through it."""

    def shard(n0: int, rows: list[tuple[str, str]]) -> Iterator[tuple[str, str, int]]:
        probes = {w: name for w, name in rows if len(w) == n0}
        if probes and len(rows) > 1:
            names = dict(rows)
            trie = Trie(names)
            for w, name in probes.items():
                for o, d in trie.near(w):
                    if d and max(len(w), len(o)) >= FUZZY_FROM:
                        yield name, names[o], d
                        yield names[o], name, d

    key, n0, held, out = None, 0, [], []
    for b in batches:
        for k, n, w, name in zip(*(b.column(i).to_pylist() for i in range(4))):
            if k != key:
                out.extend(shard(n0, held))
                key, n0, held = k, n, []
            held.append((w, name))
        if len(out) > 10_000:
            yield _pairs(out)
            out = []
    out.extend(shard(n0, held))
    yield _pairs(out)


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int32()])], names=["name", "other", "distance"])


def trie_join(names: DataFrame, name: str = "name") -> DataFrame:
    """(name, other, distance): every pair of distinct names of which all tokens but one
    agree and that one is within one edit, in both directions. Tokens are separated by
    spaces and sorted; tokens shorter than 5 letters pair with longer ones only. Null and
    empty names pair with nothing.

    A shard holds names that agree in all but a window of one token. A shard of more than
    TRIE names is cut into shards of narrower windows, until it is small or the window is
    two letters wide; no pair is lost by it, as an edit lies in one of the windows."""
    n = names.select(F.col(name).alias("name")).where("name <> ''").distinct()
    ts = F.split("name", " ")
    n = n.select("name", F.posexplode(ts).alias("at", "word"), ts.alias("ts"))
    n = n.select("name", F.array_join(F.filter("ts", lambda x, i: i != F.col("at")), " ").alias("rest"), "word", F.length("word").alias("n")).where(F.col("n") >= FUZZY_FROM - 1)
    n = n.select("name", "rest", "word", F.explode(F.array(F.col("n") - 1, F.col("n"))).alias("n0")).where(F.col("n0") >= FUZZY_FROM - 1)
    level, done, kept = _halves(n.withColumn("i", F.lit(0)).withColumn("j", F.col("n0"))), [], []
    while True:
        level = materialise(level, "shards")
        kept.append(level)
        large = level.groupBy("shard").agg(F.count("*").alias("n"), F.first("i").alias("i"), F.first("j").alias("j")).where((F.col("n") > TRIE) & (F.col("j") - F.col("i") > 2)).select("shard")
        large = materialise(large, "large-shards")
        kept.append(large)
        if large.isEmpty():
            done.append(level)
            break
        done.append(level.join(large, "shard", "left_anti"))
        level = _halves(level.join(large, "shard", "left_semi"))
    rows = reduce(DataFrame.unionByName, done).select("shard", "n0", "word", "name")
    # few bytes, much work: the number of tasks is the session's, not one for each so many bytes
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "shard").sortWithinPartitions("shard")
    pairs = materialise(rows.mapInArrow(_run_tries, "name string, other string, distance int").distinct(), "near-names")
    for t in kept:
        discard(t)
    return pairs


#: How telling a reading is: a listed given name and a family name, or all words of a
#: separated name; an initial and a family name; one word; words cut at capitals; one
#: word of which the first letter is an initial.
FULL, INITIAL, WORD, HUMPS, RUN = 0, 1, 2, 3, 4


def _readings(given: dict[str, str]):
    """(nick) -> readings (kind, given, initial, family), most plausible ones only. The
    tokens of a family name are sorted; given is '' for a whole name."""
    full = Trie({k for k in given if len(k) >= FUZZY_FROM})
    known: dict[str, tuple[str, int] | None] = {}

    def name(t: str) -> tuple[str, int] | None:
        """The given name that a token stands for, and its distance."""
        if t not in known:
            if t in given:
                known[t] = (given[t], 0)
            else:
                near = {given[w] for w, _ in full.near(t)} if len(t) >= FUZZY_FROM - 1 else set()
                known[t] = (near.pop(), 1) if len(near) == 1 else None
        return known[t]

    def initial(t: str) -> bool:
        return len(t) == 1 and t.upper() != t  # scripts without case have names of one letter

    def read(nick: str) -> list[tuple[int, str, str, str]]:
        ts, whole = tokens(nick), tokens(nick, humps=False)
        words = [t for t in ts if not initial(t)]
        out: list[tuple[int, str, str, str]] = []
        if len(ts) == 1:
            w = ts[0]
            return [(WORD, "", "", w), *([(RUN, "", w[0], w[1:])] if len(w) > 2 and initial(w[0]) else [])] if words else []
        if len(words) > 1:  # any token may be the given name, the others are the family name
            options = [(m[1], m[0], " ".join(sorted(words[:i] + words[i + 1 :]))) for i, w in enumerate(words) if (m := name(w)) is not None]
            least = min((o[0] for o in options), default=0)
            out = [(FULL, g, g[0], f) for c, g, f in options if c == least]
        if not out and words and (initial(ts[0]) or initial(ts[-1])):
            out = [(INITIAL, "", ts[0] if initial(ts[0]) else ts[-1], " ".join(sorted(words)))]
        if not out and len(words) > 1:  # initials in between don't count
            out = [(FULL if len(whole) > 1 else HUMPS, "", "", " ".join(sorted(words)))]
        if not out and len(ts) > 1:
            out = [(FULL if len(whole) > 1 else HUMPS, "", "", " ".join(sorted(ts)))]
        if out and len(whole) == 1 and out[0][0] == HUMPS and len(whole[0]) > 1:
            out.append((WORD, "", "", whole[0]))
        return list(dict.fromkeys(out))

    return read


_USES = "account string, nickname string, n bigint, kind int, given string, initial string, family string"


def name_readings(uses: DataFrame, forms: dict[str, str]) -> DataFrame:
    """uses (account, nickname, n) with each reading of the nickname: kind, given,
    initial, family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _readings(forms)
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for b in batches:
            rows = [(a, n, k, *r) for a, n, k in zip(*(b.column(i).to_pylist() for i in range(3))) for r in read(n)]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in _USES.split(", ")])

    return uses.select("account", "nickname", "n").mapInArrow(run, _USES)


def _persons(full: DataFrame, close: DataFrame) -> DataFrame:
    """(given, family, pf): each full name typed, with the family name that the person
    goes by: its own, or that of a commoner full name within one edit, and so on from
    there to the end. full: given, family, spellings (nicknames), bearers (accounts)."""
    full = full.withColumn("weight", F.struct("spellings", "bearers", "family"))
    near = full.select("given", "family", "weight").join(close.select(F.col("name").alias("family"), "other"), "family")
    better = near.join(full.select("given", F.col("family").alias("other"), F.col("weight").alias("w2")), ["given", "other"]).where("w2 > weight")
    better = better.groupBy("given", "family").agg(F.max_by("other", "w2").alias("better"))
    to = full.select("given", "family").join(better, ["given", "family"], "left").select("given", "family", F.coalesce("better", "family").alias("pf"), F.lit(True).alias("moved"))
    # each round doubles the steps taken; they lead to ever commoner names, so that they end
    before = None
    while True:
        to = materialise(to, "goes-by")
        if before is not None:
            discard(before)
        before = to
        if to.where("moved").isEmpty():
            return to.drop("moved")
        hop = to.select("given", F.col("family").alias("pf"), F.col("pf").alias("next"))
        to = to.join(hop, ["given", "pf"]).select("given", "family", F.col("next").alias("pf"), (F.col("next") != F.col("pf")).alias("moved"))


def _bearers(persons: DataFrame) -> DataFrame:
    """(family, i, lo, hi): the least and the greatest person who bears the family name
    and a given name with initial i ('': any). Of a whole name each token may be the
    given one. They are one person if lo = hi."""
    p = persons.select("given", "pf").distinct()
    ts = F.split("pf", " ")
    named = p.where("given <> ''").select(F.col("pf").alias("family"), F.substring("given", 1, 1).alias("i"), F.concat_ws(" ", "given", "pf").alias("person"))
    whole = p.where("given = ''").select(F.posexplode(ts).alias("at", "g"), ts.alias("ts"), F.col("pf").alias("person"))
    whole = whole.select(F.array_join(F.filter("ts", lambda x, k: k != F.col("at")), " ").alias("family"), F.substring("g", 1, 1).alias("i"), "person").where("family <> ''")
    by = named.unionByName(whole)
    by = by.select("family", F.explode(F.array(F.col("i"), F.lit(""))).alias("i"), "person")
    return by.groupBy("family", "i").agg(F.min("person").alias("lo"), F.max("person").alias("hi"))


def _fit(vague: DataFrame, bearers: DataFrame, close: DataFrame) -> DataFrame:
    """vague (initial, family) with d, the distance of the persons it fits best (null:
    none), and person, their name if it is just one."""
    same = vague.select("family").distinct().select("family", F.col("family").alias("pf"), F.lit(0).alias("distance"))
    reach = close.select(F.col("name").alias("family"), F.col("other").alias("pf"), "distance").unionByName(same)
    fits = vague.join(reach, "family").join(bearers.select(F.col("family").alias("pf"), F.col("i").alias("initial"), "lo", "hi"), ["pf", "initial"])
    fits = fits.groupBy("initial", "family", F.col("distance").alias("d")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = fits.groupBy("initial", "family").agg(F.min("d").alias("d"), F.min_by(F.when(F.col("lo") == F.col("hi"), F.col("lo")), "d").alias("person"))
    return vague.join(fits, ["initial", "family"], "left")


def link_accounts(accounts: DataFrame, forms: dict[str, str], account: str, nickname: str) -> DataFrame:
    """(account, person): the accounts whose owner can be told, with the name that the
    person is known by: the given and the family name, or the words of the whole name.

    accounts: rows with an account and a nickname, repeated or null ones allowed. forms:
    short or full given name (lower case) to the full one; a list of fixed size.

    Names may be in any script and have any number of words, in any order. Of several
    words each may be the given name if it is in the list; if none is, the words together
    are the name. Initials beside a listed given name or between words don't count. Words
    typed together are cut at capitals, if that gives a listed given name or a whole name
    that is also typed with separators, else they are one word. A name of bars or signs, or of one letter, says nothing.

    Persons are the full names typed; a rarer spelling within one edit of a word goes to
    the commoner one (with the same given name). An initial with a family name stands for
    the one person that it fits, exactly or else within one edit, a single word for the
    one bearer of that family name, or as initial and family name run together; if it
    fits several it says nothing, if none, it is a person of its own. An account goes by
    its most telling nicknames, then by the most frequent of these, then by name."""
    a = accounts.select(F.col(account).cast("string").alias("account"), F.col(nickname).alias("nickname")).where("account is not null and nickname is not null")
    # few bytes, much work: read in as many tasks as the session asks for
    parts = int(accounts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = a.groupBy("account", "nickname").agg(F.count("*").alias("n")).repartition(parts, "account", "nickname")
    uses = materialise(name_readings(a, forms), "readings")
    close = trie_join(uses.select(F.col("family").alias("name")))
    weigh = lambda df: df.groupBy("given", "family").agg(F.countDistinct("nickname").alias("spellings"), F.countDistinct("account").alias("bearers"))
    vague = lambda c: uses.where(c).select("initial", "family").distinct()
    told = lambda tier, df: df.select("account", "n", F.lit(tier).alias("tier"), "person")
    goes_by = F.trim(F.concat_ws(" ", "given", "pf")).alias("person")
    # full names, and words that give one when cut at capitals
    full = uses.where(F.col("kind") == FULL)
    persons = _persons(weigh(full), close)
    out = [told(0, full.join(persons, ["given", "family"]).select("account", "n", goes_by))]
    whole = persons.where("given = ''").groupBy("family").agg(F.lit("").alias("i"), F.min("pf").alias("lo"), F.max("pf").alias("hi"))
    out.append(told(3, uses.where(F.col("kind") == HUMPS).join(_fit(vague(F.col("kind") == HUMPS), whole, close).where("person is not null"), ["initial", "family"])))
    # an initial and a family name
    short = uses.where(F.col("kind") == INITIAL)
    fits = materialise(_fit(vague(F.col("kind") == INITIAL), _bearers(persons), close), "initials")
    alone = short.join(fits.where("d is null").select("initial", "family"), ["initial", "family"]).withColumn("given", F.concat("initial", F.lit(".")))
    extra = _persons(weigh(alone), close)
    out.append(told(1, short.join(fits.where("person is not null").select("initial", "family", "person"), ["initial", "family"])))
    out.append(told(1, alone.join(extra, ["given", "family"]).select("account", "n", goes_by)))
    # one word
    one = F.col("kind").isin(WORD, RUN)
    fits = _fit(vague(one), _bearers(persons.unionByName(extra)), close)
    words = uses.where(one).join(fits, ["initial", "family"])
    rank = F.when(F.col("d").isNotNull(), F.col("d")).when(F.col("kind") == WORD, 5)
    words = words.withColumn("rank", rank).where("rank is not null").withColumn("person", F.when(F.col("d").isNull(), F.concat(F.lit("- "), "family")).otherwise(F.col("person")))
    words = words.groupBy("account", "nickname", "n").agg(F.min_by(F.struct("person", F.when(F.col("d").isNull(), 4).otherwise(2).alias("tier")), F.struct("rank", F.col("kind") == RUN)).alias("b"))
    out.append(words.select("account", "n", "b.tier", "b.person").where("person is not null"))
    best = reduce(DataFrame.unionByName, out).groupBy("account", "tier", "person").agg(F.sum("n").alias("n"))
    return best.groupBy("account").agg(F.min_by("person", F.struct("tier", -F.col("n"), "person")).alias("person"))


def account_pairs(links: DataFrame) -> DataFrame:
    """(a, b), a < b: the accounts of one person, each pair once."""
    x = links.select("person", F.col("account").alias("a"))
    y = links.select("person", F.col("account").alias("b"))
    return x.join(y, "person").where("a < b").select("a", "b")
