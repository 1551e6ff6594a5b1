"""Variant spellings of names typed by people: entries of one person linked.

Each entry is read into the parts of its name (own, father's, grandfather's, kunya, by-name, nisba) from the canonical
name and all aliases, in Arabic or Latin script. Entries meet when a part has the same ending (suffix blocking). No
ending is dropped, however common: two dated entries of one ending meet only where their years can agree, as other
years rule a pair out; all other pairs are compared, those of common endings in salted blocks. Pairs are compared part by part by the ratio of their longest common subsequence; a part that is present and
different rules a pair out, and what is left must agree in enough parts. Pairs are closed to groups at the end.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.components import connected_components
from scriptorium.runtime import cut

#: Endings shorter than this are not indexed, for family names and for other parts.
LONG_SUFFIX, SHORT_SUFFIX = 4, 3
#: The entries of an ending with more than this are compared in blocks of pairs of about BLOCK entries.
COMMON, BLOCK = 64, 512
#: Least ratio of the longest common subsequence for two forms of one part.
RATIO = 0.75
#: A form is an established name, which is no misspelling of another one, if so many entries hold it and so large a share.
KNOWN_ENTRIES, KNOWN_SHARE = 6, 0.001
PARTS = ("own", "father", "grandfather", "kunya", "byname", "nisba")

# Letters folded, words that join the parts of a name, spellings of one sound.
_FOLD = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ی": "ي", "ک": "ك", "ة": "ه", "ؤ": "و", "ئ": "ي"})
_SONS = {"بن", "ابن", "ibn", "bin", "ben", "b"}
_FATHERS = {"ابو", "ابي", "ابا", "ام", "abu", "abou", "abi", "aboo", "umm"}
_SOUNDS = (("dj", "j"), ("sh", "S"), ("ch", "S"), ("gh", "g"), ("kh", "k"), ("ph", "f"), ("dh", "z"), ("th", "s"), ("q", "k"), ("c", "k"), ("v", "w"), ("d", "z"))
_SERVANTS = {"عبد", "abd"}


def _tokens(name: str) -> list[str]:
    name = unicodedata.normalize("NFKD", name)
    name = "".join(c for c in name if unicodedata.category(c) not in ("Mn", "Cf") or c in "ٕٔ")
    name = unicodedata.normalize("NFC", name).replace("ٔ", "").replace("ٕ", "").replace("ـ", "").casefold().translate(_FOLD)
    if m := re.fullmatch(r"\s*([^،,]+)[،,](.+)", name):
        name = f"{m[2]} {m[1]}"
    raw = re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?", name)
    out: list[str] = []
    i = 0
    while i < len(raw):
        t = raw[i]
        if t in ("al", "el", "ul", "ال") and i + 1 < len(raw):
            i += 1
            t = f"al-{raw[i]}" if t != "ال" else "ال" + raw[i]
        elif t.startswith(("el-", "ul-")):
            t = "al-" + t[3:]
        if out and out[-1] in _SERVANTS and t not in _SONS:
            out[-1] += t.replace("-", "")
        else:
            out.append(t)
        i += 1
    return out


def _latin(form: str) -> bool:
    return form[:1].isascii()


# Results kept within a task; started afresh when full.
_KEPT: dict = {}


def _once(function, *args):
    key = (function.__name__, *args)
    if key not in _KEPT:
        if len(_KEPT) > 500_000:
            _KEPT.clear()
        _KEPT[key] = function(*args)
    return _KEPT[key]


def skeleton(form: str) -> str:
    """A Latin form by its consonants, with spellings of one Arabic letter as one."""
    return _once(_skeleton, form)


def lcs_ratio(a: str, b: str) -> float:
    """Twice the length of the longest common subsequence over the sum of the lengths."""
    return _once(_lcs_ratio, a, b)


def _skeleton(form: str) -> str:
    s = form.removeprefix("al-").replace("-", "")
    if s.startswith("abd") and len(s) > 5:
        # abd al-x, abdul x and abdur rahim are one.
        return "A" + _skeleton(re.sub("^[au]l?(?=[^aeiou])", "", s[3:]))
    s = re.sub("^ou(?=[aeiou])", "w", s)
    for a, b in _SOUNDS:
        s = s.replace(a, b)
    s = re.sub(r"(.)\1+", r"\1", s)
    s = s[:-1] if s.endswith("h") and len(s) > 2 else s
    core = s[:1].strip("aeiouy") + re.sub("[aeiouyw'’]", "", s[1:])
    return re.sub(r"(.)\1+", r"\1", core) or s


def _bare(form: str) -> str:
    """A family or by-name without its article."""
    return form[3:] if form.startswith("al-") else form[2:] if form.startswith("ال") and len(form) > 4 else form


def read_name(name: str) -> dict[str, str]:
    """The parts of one written name."""
    tokens = _tokens(name)
    parts: dict[str, str] = {}
    chain: list[str] = []
    rest: list[str] = []
    i, sons = 0, any(t.rstrip(".") in _SONS for t in tokens[1:])
    if tokens and tokens[0] in _FATHERS and len(tokens) > 1:
        parts["kunya"] = _bare(tokens[1])
        i = 2
    first = True
    while i < len(tokens):
        t = tokens[i]
        if t.rstrip(".") in _SONS and i + 1 < len(tokens):
            chain.append(tokens[i + 1])
            i += 2
        else:
            if sons and first:
                chain.append(t)
            else:
                rest.append(t)
            i += 1
        first = False
    if not sons:
        # Without the word for son the last part is the family name, and by-names have the article.
        if len(rest) > 1 and rest[-1].startswith(("al-", "ال")):
            if len(rest) == 2 and rest[0].startswith(("al-", "ال")):
                parts["byname"] = _bare(rest[0])
            elif len(rest) >= 3 and rest[-2].startswith(("al-", "ال")) and len(rest) < 4:
                parts["byname"], chain = _bare(rest[-2]), rest[:-2]
            else:
                chain = rest[:-1]
            parts["nisba"] = _bare(rest[-1])
        elif len(rest) == 1 and ("kunya" in parts or rest[0].startswith(("al-", "ال"))):
            parts["nisba"] = _bare(rest[0])
        else:
            chain = rest
    elif rest:
        parts["nisba"] = _bare(rest[-1])
        if len(rest) > 1:
            parts["byname"] = _bare(rest[-2])
    for part, value in zip(PARTS, chain):
        parts[part] = value
    return parts


def read_entry(canonical: str | None, aliases, kunya: str | None, nisba: str | None) -> dict[str, list[str]]:
    """All forms of each part, from every name of the entry."""
    found: dict[str, set[str]] = {p: set() for p in PARTS}
    for name in [canonical, *(aliases if aliases is not None else [])]:
        if name:
            for part, form in read_name(name).items():
                found[part].add(form)
    if kunya:
        t = _tokens(kunya)
        found["kunya"].add(_bare(t[1] if len(t) > 1 and t[0] in _FATHERS else t[0]) if t else "")
    if nisba and (t := _tokens(nisba)):
        found["nisba"].add(_bare(t[-1]))
    return {p: sorted(f - {""}) for p, f in found.items()}


def _lcs_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    # One machine word per row: bit j is 0 where the row's length grows at b's letter j.
    places: dict[str, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = row = (1 << len(b)) - 1
    for x in a:
        same = row & places.get(x, 0)
        row = (row + same | row - same) & every
    return 2 * (len(b) - row.bit_count()) / (len(a) + len(b))


def alike(a: str, b: str, known: frozenset) -> int | None:
    """1 if two forms may be one name, -1 if not, None if they can't be compared (different scripts)."""
    if a == b:
        return 1
    if _latin(a) != _latin(b):
        return None
    if a.endswith(".") or b.endswith(".") or len(a) == 1 or len(b) == 1:
        x, y = (f.rstrip(".") for f in (a, b))
        return 1 if x[:1] == y[:1] or _latin(x) and {x[:1], y[:1]} in ({"o", "w"}, {"e", "i"}, {"c", "s"}, {"o", "u"}) or _latin(x) and skeleton(x)[:1] == skeleton(y)[:1] else -1
    if _latin(a):
        x, y = skeleton(a), skeleton(b)
        if x == y:
            return 1
        if a in known and b in known:
            return -1
        return 1 if max(lcs_ratio(x, y) if min(len(x), len(y)) > 3 else 0, lcs_ratio(a, b)) >= RATIO + 0.03 else -1
    if a in known and b in known:
        return -1
    return 1 if lcs_ratio(a, b) >= RATIO else -1


def part_agrees(a: list[str], b: list[str], known: frozenset) -> int:
    """1 if some forms of a part agree, -1 if both have it and none does, 0 if it can't be told."""
    worst = 0
    for x in a:
        for y in b:
            s = alike(x, y, known)
            if s == 1:
                return 1
            worst = worst if s is None else -1
    return worst


def years_agree(a: list[int], b: list[int]) -> int:
    """Years typed one off, in either direction, may be two apart."""
    if not a or not b:
        return 0
    return 1 if any(abs(x - y) <= 2 for x in a for y in b) else -1


def same_person(a: dict, b: dict, known: frozenset) -> int:
    """1 if two entries are one person, -1 if a part rules it out, 0 if too little agrees."""
    year = years_agree(a["years"], b["years"])
    if year < 0:
        return -1
    s = {p: part_agrees(a[p], b[p], known) for p in PARTS}
    against = [p for p in PARTS if s[p] < 0]
    if against:
        # One badly typed given name is forgiven where the family name and two of kunya, year and both others agree.
        names = [p for p in PARTS[:3] if s[p] > 0]
        backed = (s["kunya"] > 0) + (year > 0) + (len(names) > 1)
        if len(against) > 1 or against[0] not in PARTS[:3] or s["nisba"] <= 0 or not names or backed < 2:
            return -1
        close = [(lcs_ratio(x, y), x in known and y in known) for x in a[against[0]] for y in b[against[0]]]
        sure = len(names) > 1 and s["kunya"] > 0
        return 1 if any(r >= 0.5 and not both or r >= RATIO and sure for r, both in close) else -1
    if s["nisba"] > 0:
        enough = s["own"] > 0 and (s["father"] > 0 or s["kunya"] > 0 or s["byname"] > 0 and year > 0) or year > 0 and (s["kunya"] > 0 or s["byname"] > 0 and s["kunya"] == 0)
    else:
        enough = s["own"] > 0 and s["father"] > 0 and (s["grandfather"] > 0) + (s["kunya"] > 0) + (year > 0) + (s["byname"] > 0) >= 2
    return 1 if enough else 0


def _suffix(form: str, n: int) -> str | None:
    """The ending by which a form is indexed; Latin forms by their consonants."""
    s = skeleton(form) if _latin(form) else form
    if form.endswith(".") or len(form) < 2:
        return None
    return s[-n:]


def block_keys(e: dict) -> list[tuple[str, bool]]:
    """(key, loose) of an entry: endings of family names with the year, and of given names with another part.

    Under a loose key, the ending of a family name alone, only pairs with an undated entry need comparing: dated ones
    whose years agree share the key with the year."""
    keys: dict[str, bool] = {}
    ends = {p: {x for f in e[p] if (x := _suffix(f, LONG_SUFFIX if p == "nisba" else SHORT_SUFFIX))} for p in PARTS}
    years = {str(y + k) for y in e["years"] for k in (0, 1, 2)}
    for n in ends["nisba"]:
        keys[f"n|{n}"] = True
        for y in years:
            keys[f"ny|{n}|{y}"] = False
    for o in ends["own"]:
        for f in ends["father"]:
            for tag, values in (("g", ends["grandfather"]), ("k", ends["kunya"]), ("y", years)):
                for v in values:
                    keys[f"of{tag}|{o}|{f}|{v}"] = False
    return list(keys.items())


def block_pairs(left: list[dict], right: list[dict] | None, loose: bool, known: frozenset) -> list[tuple[str, str]]:
    """(sig, sig) of the same persons between two lists of entries, or within one.

    An undated pair that is accepted agrees in two of own name, father's and kunya, so pairs that don't are passed over."""
    kept: dict = {}

    def agree(a: list[str], b: list[str]) -> bool:
        if not a or not b:
            return False
        key = tuple(a), tuple(b)
        if key not in kept:
            kept[key] = part_agrees(a, b, known) > 0
        return kept[key]

    out = []
    for i, x in enumerate(left):
        for y in left[i + 1 :] if right is None else right:
            if not x["years"] or not y["years"]:
                own, father = agree(x["own"], y["own"]), agree(x["father"], y["father"])
                if not (own and father or (own or father) and agree(x["kunya"], y["kunya"])):
                    continue
            elif loose:
                continue
            if same_person(x, y, known) == 1:
                out.append((min(x["sig"], y["sig"]), max(x["sig"], y["sig"])))
    return out


_FORMS = ", ".join(f"{p} array<string>" for p in PARTS)


def entries(df: DataFrame) -> DataFrame:
    """(id, parts..., years): one row per id, with the forms of all its rows."""
    rows = df.select("id", "canonical_name", "aliases", "kunya", "nisba", "death_year").filter("id is not null").distinct()

    def read(batches):
        for pdf in batches:
            got = [read_entry(*r) for r in zip(pdf["canonical_name"], pdf["aliases"], pdf["kunya"], pdf["nisba"])]
            out = pd.DataFrame({"id": pdf["id"], **{p: [g[p] for g in got] for p in PARTS}})
            out["years"] = [[] if pd.isna(y) else [int(y)] for y in pdf["death_year"]]
            yield out

    read_rows = rows.mapInPandas(read, f"id string, {_FORMS}, years array<int>")
    return read_rows.groupBy("id").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in (*PARTS, "years")])


def person_groups(df: DataFrame) -> DataFrame:
    """(id, person, entries): every id with the least id of its person and how many ids that person has; ids that pair
    with none are persons of their own. Null ids are left out."""
    ids = df.select("id").filter("id is not null").distinct()
    member = connected_components(person_pairs(df), "narrator_a", "narrator_b")
    told = ids.join(member, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("person"))
    sizes = told.groupBy(F.col("person").alias("p")).agg(F.count("*").alias("entries"))
    return told.join(sizes, F.col("person") == F.col("p")).select("id", "person", "entries")


def person_pairs(df: DataFrame) -> DataFrame:
    """(narrator_a, narrator_b): all pairs of different ids that are the same person.

    Entries that read the same (same parts and years) are compared once. Ids delivered twice are one entry with the
    forms of both; null ids are left out; an entry without any name or with parts of no ending pairs only with
    entries that read the same, and an entry without any part with none.
    """
    columns = (*PARTS, "years")
    read = cut(entries(df).withColumn("sig", F.md5(F.to_json(F.struct(*columns)))))
    kinds = cut(read.groupBy("sig").agg(*[F.first(c).alias(c) for c in columns]).filter(" or ".join(f"size({p}) > 0" for p in PARTS)))
    # An entry has some ten forms, so no more than 10 / KNOWN_SHARE forms are established, whatever the data.
    often = max(KNOWN_ENTRIES, int(kinds.count() * KNOWN_SHARE))
    common = kinds.select(F.explode(F.array_distinct(F.concat(*PARTS))).alias("form")).groupBy("form").count().filter(F.col("count") >= often)
    known = df.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in common.collect()))

    def index(batches):
        for batch in batches:
            rows = zip(batch.column("sig").to_pylist(), *[batch.column(c).to_pylist() for c in columns])
            out = [(s, k, loose, not v[-1]) for s, *v in rows for k, loose in block_keys(dict(zip(columns, v)))]
            sig, key, loose, undated = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.string()), pa.array(key, pa.string()), pa.array(loose, pa.bool_()), pa.array(undated, pa.bool_())], ["sig", "key", "loose", "undated"])

    keys = cut(kinds.mapInArrow(index, "sig string, key string, loose boolean, undated boolean").withColumn("k", F.xxhash64("key")).select("sig", "k", "loose", "undated"))
    sizes = cut(keys.groupBy(F.col("k").alias("kk"), F.col("loose").alias("l")).agg(F.count("*").alias("n"), F.max("undated").alias("any")).filter("n > 1 and (any or not l)"))
    blocks = keys.join(sizes.filter(F.col("n") <= COMMON).select("kk", "l"), (F.col("k") == F.col("kk")) & (F.col("loose") == F.col("l")), "left_semi")
    other = blocks.select(F.col("sig").alias("other"), F.col("k").alias("k2"), F.col("loose").alias("l2"), F.col("undated").alias("u2"))
    meets = ~F.col("loose") | F.col("undated") | F.col("u2")
    met = blocks.join(other, (F.col("k") == F.col("k2")) & (F.col("loose") == F.col("l2")) & (F.col("sig") < F.col("other")) & meets).select("sig", "other").distinct()

    def judged(pairs: DataFrame, left: str, right: str) -> DataFrame:
        a = kinds.select(*[F.col(c).alias(f"a_{c}") for c in ("sig", *columns)])
        b = kinds.select(*[F.col(c).alias(f"b_{c}") for c in ("sig", *columns)])
        both = pairs.join(a, F.col(left) == F.col("a_sig")).join(b, F.col(right) == F.col("b_sig"))

        def judge(batches):
            for batch in batches:
                sides = [[dict(zip(columns, v)) for v in zip(*[batch.column(f"{x}_{c}").to_pylist() for c in columns])] for x in "ab"]
                verdict = pa.array([same_person(p, q, known.value) for p, q in zip(*sides)], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("a_sig"), batch.column("b_sig"), verdict], ["x", "y", "verdict"])

        return both.mapInArrow(judge, "x string, y string, verdict int")

    def meet(block: pa.Table) -> pa.Table:
        rows = block.to_pylist()
        low, high = rows[0]["low"], rows[0]["high"]
        left, right = [r for r in rows if r["salt"] == low], None if low == high else [r for r in rows if r["salt"] == high]
        x, y = zip(*found) if (found := block_pairs(left, right, rows[0]["loose"], known.value)) else ((), ())
        return pa.table({"x": pa.array(x, pa.string()), "y": pa.array(y, pa.string())})

    # A common ending's entries are salted into parts, and every part meets every part.
    large = sizes.filter(F.col("n") > COMMON).select("kk", "l", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    salted = keys.join(large, (F.col("k") == F.col("kk")) & (F.col("loose") == F.col("l"))).select("sig", "k", "loose", "parts", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int").alias("salt"))
    salted = salted.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("sig", "k", "loose", "salt", F.least("salt", "met").alias("low"), F.greatest("salt", "met").alias("high"))
    parted = salted.join(kinds.withColumnRenamed("sig", "s"), F.col("sig") == F.col("s")).drop("s").groupBy("k", "loose", "low", "high").applyInArrow(meet, "x string, y string")
    linked = cut(judged(met, "sig", "other").filter("verdict = 1").select("x", "y").unionByName(parted).distinct())
    groups = connected_components(linked, "x", "y")
    member = groups.select("component", F.col("node").alias("sig"))
    inner = member.join(member.select(F.col("component").alias("c2"), F.col("sig").alias("other")), (F.col("component") == F.col("c2")) & (F.col("sig") < F.col("other"))).select("sig", "other")
    closed = judged(inner, "sig", "other").filter("verdict >= 0").select("x", "y")
    ids = read.select("id", "sig").join(kinds.select(F.col("sig").alias("s")), F.col("sig") == F.col("s"), "left_semi")
    across = closed.join(ids.select(F.col("id").alias("p"), F.col("sig").alias("sp")), F.col("x") == F.col("sp")).join(
        ids.select(F.col("id").alias("q"), F.col("sig").alias("sq")), F.col("y") == F.col("sq")
    ).select("p", "q")
    same = ids.join(ids.select(F.col("id").alias("q"), F.col("sig").alias("sq")), (F.col("sig") == F.col("sq")) & (F.col("id") < F.col("q"))).select(F.col("id").alias("p"), "q")
    return across.unionByName(same).select(F.least("p", "q").alias("narrator_a"), F.greatest("p", "q").alias("narrator_b")).distinct()
