"""URL filters by association rules: Spark FP-growth mines token combinations from labelled urls.

The labels are the given rules' own verdicts, so mined rules mostly carry what marks a rule's urls, such as its first
path segment, over to hosts that no rule names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARK = "verdict="


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without :// or url."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of (rule, verdict) whose host is the host or a parent of it and whose path starts the path, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """All tokens of a url, each once, digits written as 0: every host label, path segment and query key wherever it
    stands, and scheme, top-level domain, the last two labels, first segment, ending and fragment."""
    labels = F.split(host, r"\.")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    last = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    query = F.coalesce(F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1), F.lit(""))
    one = {
        "scheme": F.coalesce(F.regexp_extract(url, r"(?s)\A(.*?)://", 1), F.lit("")),
        "tld": F.try_element_at(labels, F.lit(-1)),
        "site": F.when(F.size(labels) > 1, F.concat_ws(".", F.slice(labels, -2, 2))),
        "top": F.try_element_at(segments, F.lit(1)),
        "end": F.when(path.endswith("/"), F.lit("/")).otherwise(F.regexp_extract(last, r"(\.[A-Za-z0-9]+)\z", 1)),
        "part": F.regexp_extract(url, r"#(.*)\z", 1),
    }
    many = {"host": labels, "seg": segments, "key": F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))}

    def token(kind: str, v: Column) -> Column:
        return F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{kind}:"), F.regexp_replace(v, "[0-9]+", "0")))

    made = [F.array(*[token(k, v) for k, v in one.items()])] + [F.transform(v, partial(token, k)) for k, v in many.items()]
    return F.array_distinct(F.array_compact(F.concat(*made)))


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.9) -> list[tuple[frozenset, str, float, float]]:
    """(tokens, verdict, confidence, support) from (tokens, verdict) rows, best first.

    Every labelled row counts. A rule goes when a rule on fewer of its tokens has its verdict and no less confidence.
    So FP-growth sees only tokens that longer rules can hold: those below min_support are in none, and neither are
    those with one verdict or in every row, whose longer rules go in favour of shorter ones. No labelled rows: no rules.
    """
    rows = labelled.filter(F.size("tokens") > 0)
    total = rows.count()
    if not total:
        return []
    single = rows.select(F.explode(F.array_distinct("tokens")).alias("k"), "verdict").groupBy("k", "verdict").agg(F.count("*").alias("n"))
    often = single.groupBy("k").agg(F.sum("n").alias("n"), F.collect_list(F.struct("verdict", "n")).alias("v")).filter(F.col("n") >= min_support * total).collect()
    rules = [(frozenset([r["k"]]), v["verdict"], v["n"] / r["n"], v["n"] / total) for r in often for v in r["v"] if v["n"] >= min_support * total and v["n"] >= min_confidence * r["n"]]
    open_ = [r["k"] for r in often if len(r["v"]) > 1 and r["n"] < total]
    if len(open_) > 1:
        sent = F.array(*[F.lit(k) for k in sorted(open_)])
        baskets = rows.select(F.concat(F.array_intersect("tokens", sent), F.array(F.concat(F.lit(_MARK), "verdict"))).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
        found = model.associationRules.filter(F.col("consequent")[0].startswith(_MARK) & (F.size("antecedent") > 1)).select("antecedent", "consequent", "confidence", "support").collect()
        rules += [(frozenset(r[0]), r[1][0].removeprefix(_MARK), r[2], r[3]) for r in found]
    rules.sort(key=lambda r: (-r[2], -r[3], len(r[0]), r[1], sorted(r[0])))
    kept: dict[str, list[tuple[frozenset, float]]] = defaultdict(list)
    out = []
    for rule in sorted(rules, key=lambda r: len(r[0])):
        if not any(less < rule[0] and sure >= rule[2] for less, sure in kept[rule[1]]):
            kept[rule[1]].append((rule[0], rule[2]))
            out.append(rule)
    return sorted(out, key=lambda r: (-r[2], -r[3], len(r[0]), r[1], sorted(r[0])))


class Matcher:
    """Inverted index from token to the rules that ask for it; a rule fires when all its tokens were counted."""

    def __init__(self, rules: Sequence[tuple[frozenset, str, float, float]]):
        self.rules = list(rules)
        self.index: dict[str, list[int]] = defaultdict(list)
        for i, rule in enumerate(self.rules):
            for token in rule[0]:
                self.index[token].append(i)

    def best(self, tokens: Sequence[str]) -> int | None:
        """The position of the first rule, in order of merit, that fires."""
        seen: dict[int, int] = defaultdict(int)
        for token in set(tokens):
            for i in self.index.get(token, ()):
                seen[i] += 1
        return min((i for i, n in seen.items() if n == len(self.rules[i][0])), default=None)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", min_support: float = 0.01, min_confidence: float = 0.9) -> DataFrame:
    """(id, host, path, rule, verdict, mined, confidence) for every row of pages, in one pass after the mining.

    Urls under one of the rules are the labelled ones; association rules mined from them judge the others, and
    `default` holds where none fires. A null url, one without :// and an empty one have host and path empty, no
    rule and the default verdict. Repeated rows and null ids are judged like any; other columns are not read.
    """
    spark = common.session(pages.sparkSession)
    verdicts = dict(rules)
    url = F.col("u")
    base = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"))
    base = base.select("i", "u", host_of(url).alias("h"), path_of(url).alias("p"))
    base = base.select("i", "h", "p", rule_of(F.col("h"), F.col("p"), rules).alias("r"), F.when(F.col("h") == "", F.array().cast("array<string>")).otherwise(tokens_of(url, F.col("h"), F.col("p"))).alias("tokens"))
    ruled = F.create_map(*[F.lit(x) for kv in verdicts.items() for x in kv])[F.col("r")] if verdicts else F.lit(None).cast("string")
    mined = mine(base.filter("r IS NOT NULL").select("tokens", ruled.alias("verdict")), min_support, min_confidence)
    sent = spark.sparkContext.broadcast(mined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        memo: dict[tuple, int | None] = {}
        for b in batches:
            verdict, why, sure = [], [], []
            for rule, tokens in zip(b.column("r").to_pylist(), b.column("tokens").to_pylist()):
                key = tuple(tokens)
                if key not in memo:
                    if len(memo) > 100_000:
                        memo.clear()
                    memo[key] = matcher.best(key)
                fired = matcher.rules[memo[key]] if memo[key] is not None else None
                verdict.append(verdicts[rule] if rule is not None else fired[1] if fired else default)
                why.append(" & ".join(sorted(fired[0])) if fired else None)
                sure.append(fired[2] if fired else None)
            cols = [b.column("i"), b.column("h"), b.column("p"), b.column("r"), pa.array(verdict, pa.string()), pa.array(why, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["i", "h", "p", "r", "verdict", "mined", "confidence"])

    kind = base.schema["i"].dataType.simpleString()
    out = base.mapInArrow(run, f"i {kind}, h string, p string, r string, verdict string, mined string, confidence double")
    return out.select(F.col("i").alias(id_col), F.col("h").alias("host"), F.col("p").alias("path"), F.col("r").alias("rule"), "verdict", "mined", "confidence")
