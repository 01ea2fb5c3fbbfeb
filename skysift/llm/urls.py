"""URL filters: rules by host and path, and logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.textkit import utf8_buffers

#: (host and path, verdict): a rule fits the host and its subdomains if the path starts with the rule's; the longest wins.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

BITS = 16
SIZES = (3, 4, 5)
#: The label table may have so many rows; more are refused.
MOST_LABELS = 10_000
#: Urls that are scored at a time.
ROWS = 4096

#: The built-in label table: a host is a stem and a modifier, joined with or without a hyphen, in either order. The stem and the path's kind decide the
#: label; modifiers, hyphens, endings and fronts occur alike on both sides. Made-up words stand for hosts that no stem tells anything about.
BLOCKED = ["casino", "poker", "jackpot", "roulette", "betting", "slots", "lottery", "viagra", "pills", "pharma", "meds", "steroid", "porn", "xxx", "hotcams", "escort", "payday", "loans", "moneyfast", "cashprize", "winner", "giveaway", "replica", "counterfeit", "warez", "keygen", "cracked", "torrent", "malware", "phishing", "spyware", "spam", "clickbait", "popups", "adserver", "backlinks", "linkfarm", "cryptodoubler", "miraclediet", "weightloss"]
ALLOWED = ["news", "wiki", "library", "museum", "university", "research", "weather", "recipes", "travel", "science", "archive", "history", "garden", "music", "school", "council", "theatre", "journal", "hospital", "college", "forum", "community", "photography", "railway", "harbour", "chess", "poetry", "film", "kitchen", "bookshop", "maths", "physics", "biology", "football", "knitting", "cycling", "gallery", "orchestra", "village", "newspaper"]
MODIFIERS = ["best", "my", "the", "online", "daily", "club", "free", "world", "house", "new", "local", "open", "group", "north", "green", "net", "city", "plus", "24", "top", "hub", "zone"]
ENDINGS = ["com", "net", "org", "info", "io", "co.uk", "de", "fr", "es"]
FRONTS = ["", "www.", "blog.", "m.", "en."]
NEUTRAL_PATHS = ["/", "", "/en/{}", "/index.html", "/fr/{}.html", "/{}/", "/de/{}"]
BLOCKED_PATHS = ["/win/{}", "/bonus/{}", "/signup-now/{}", "/free-download/{}", "/cheap-offer-{}.php", "/xxx/{}", "/click/{}", "/promo/buy-{}"]
ALLOWED_PATHS = ["/articles/{}", "/docs/{}.html", "/about/{}", "/2021/05/{}", "/wiki/Page_{}", "/catalogue/{}", "/lectures/{}", "/news/story-{}"]
SYLLABLES = ["an", "be", "cor", "dal", "er", "fen", "gi", "hol", "in", "jo", "ka", "lin", "mor", "ne", "or", "pel", "qui", "ra", "sta", "tu", "ul", "ver", "wes", "yan"]


def seed_labels(per_stem: int = 8, made_up: int = 320) -> list[tuple[str, int]]:
    """A small labelled table (url, 1 to block), made by rule from the words above."""
    out = []
    for label, stems, own in ((1, BLOCKED, BLOCKED_PATHS), (0, ALLOWED, ALLOWED_PATHS)):
        for i, stem in enumerate(stems):
            for k in range(per_stem):
                n = i * per_stem + k
                pair = (stem, MODIFIERS[(5 * i + 3 * k) % len(MODIFIERS)])
                host = ("-" if k % 2 else "").join(pair if k // 2 % 2 else pair[::-1])
                path = (NEUTRAL_PATHS if k % 3 else own)[n % (len(NEUTRAL_PATHS) if k % 3 else len(own))].format(100 + 7 * n)
                out.append((f"https://{FRONTS[(i + k) % len(FRONTS)]}{host}.{ENDINGS[(2 * i + k) % len(ENDINGS)]}{path}", label))
    for n in range(made_up):
        word = "".join(SYLLABLES[(n * s + s * s) % len(SYLLABLES)] for s in (5, 7, 11)[: 2 + n % 2])
        host = word if n % 4 else f"{word}-{SYLLABLES[n % len(SYLLABLES)]}{MODIFIERS[n % len(MODIFIERS)]}"
        path = (NEUTRAL_PATHS if n % 4 else ALLOWED_PATHS)[n % (len(NEUTRAL_PATHS) if n % 4 else len(ALLOWED_PATHS))].format(n)
        out.append((f"https://{FRONTS[n % len(FRONTS)]}{host}.{ENDINGS[n % len(ENDINGS)]}{path}", 0))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without "://"."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[end:]
    stop = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct hashed character n-grams of hosts and paths, bounded by ^ and $ and marked by which of the two they are from."""
    keys = []
    for mark, column in ((1, hosts), (2, paths)):
        data, starts = utf8_buffers(pc.binary_join_element_wise("^", pc.fill_null(column, ""), "$", ""))
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[starts]
        for n in SIZES:
            number = np.maximum(np.diff(at) - n + 1, 0)
            row = np.repeat(np.arange(len(number)), number)
            first = np.arange(len(row)) + np.repeat(at[:-1] - (np.cumsum(number) - number), number)
            h = np.full(len(row), mark * 0x9E37 + n, np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) ^ points[first + k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            keys.append(row.astype(np.int64) << BITS | (h >> np.uint32(32 - BITS)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        """Probability of block of each url."""
        row, f = features(hosts, paths)
        n = len(hosts)
        z = np.bincount(row, self.weights[f], n) / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        return 1 / (1 + np.exp(-(z + self.bias)))


def train(labels: list[tuple[str, int]], rounds: int = 300, rate: float = 20.0, decay: float = 1e-4) -> Model:
    """Full-batch gradient descent from zero: the same table gives the same model. An empty table gives 0.5 everywhere, which allows."""
    if len(labels) > MOST_LABELS:
        raise ValueError(f"the label table has {len(labels)} rows; at most {MOST_LABELS} are taken")
    w, b = np.zeros(1 << BITS), 0.0
    if not labels:
        return Model(w, b)
    hosts, paths = zip(*(split_url(u) for u, _ in labels))
    at, flat = features(pa.array(hosts, pa.string()), pa.array(paths, pa.string()))
    y = np.array([v for _, v in labels], float)
    scale = 1 / np.sqrt(np.maximum(np.bincount(at, minlength=len(y)), 1))
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(np.bincount(at, w[flat], len(y)) * scale + b)))
        g = (p - y) * balance
        w -= rate * (np.bincount(flat, (g * scale)[at], len(w)) + decay * w)
        b -= rate * g.sum()
    return Model(w, float(b))


def host_column(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_column(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        h, p = rule.split("/", 1)
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(f"/{p}"))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, labels: list[tuple[str, int]] | None = None, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pages (page_id, url, ...) -> (page_id, host, path, rule, verdict, score), a row for each row.

    The model is trained on the driver from the small label table and judges every url; where a rule fits, its verdict stands. A null url or one
    without "://" has an empty host and path and is judged like any other text. Equal urls get equal verdicts; repeated rows and null ids stay rows of
    their own. An empty table gives an empty one; extra columns, whatever their names, are not read. A very long url is read as a whole."""
    model = train(seed_labels() if labels is None else labels)
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    id_type = pages.schema["page_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.scores(b.column("host"), b.column("path")))], names=[*b.schema.names, "score"])

    u = pages.select("page_id", host_column(F.col("url")).alias("host"), path_column(F.col("url")).alias("path"))
    scored = u.mapInArrow(score, f"page_id {id_type}, host string, path string, score double")
    r = rule_column(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(r["verdict"], F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", r["rule"].alias("rule"), verdict.alias("verdict"), "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
