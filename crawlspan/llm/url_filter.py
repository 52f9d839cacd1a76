"""URL filter: unigram Viterbi segmentation of host and path, scored by multinomial naive Bayes.

Names such as `cheapflights` hide their words. Every run of letters in a URL is
split into the words that a unigram model, counted over the text of all pages
and the training names, makes likeliest; naive Bayes then adds up the log-odds
of those words, host words (`h:cheap`) apart from path words (`p:cheap`).
Segmentation runs once for each distinct run, and only those of its substrings
that are words at all are joined to it, so that the unigram table is never
broadcast. Counts and words are written once and reread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlspan.session import cut_lineage

#: Known words up to this length are looked for inside a run; longer ones, known or not, can only be whole unknown stretches.
LONGEST = 24
#: Chance of an unknown word of one letter, in occurrences, and what each further letter divides it by.
UNKNOWN, PER_LETTER = 10.0, 10.0

#: Labelled addresses to train on where the caller has none: (address, blocked). Hyphens tell the words of a name, which thereby enter the unigram counts.
ADDRESSES = tuple(
    [(f"http://{host}/", 1) for host in (
        "ads-track.example", "ad-server.example", "ads-click.example", "click-track.example", "pop-ads.example", "banner-ads.example", "track-click-pixel.example", "adult-x.example", "adult-cams.example",
        "x-videos-adult.example", "live-adult-chat.example", "sex-cams.example", "hot-sex-chat.example", "casino-win.example", "win-casino-bonus.example", "online-casino.example", "poker-casino.example",
        "free-poker-chips.example", "free-bets.example", "sports-bets-bonus.example", "bets-win.example", "slots-win-bonus.example", "cheap-pills.example", "pills-online.example", "viagra-pills.example",
        "cheap-viagra.example", "weight-loss-pills.example", "spam-farm.example", "link-farm.example", "seo-spam-links.example", "replica-watches-cheap.example", "payday-loans-fast.example", "cheap-loans.example",
        "warez-crack-keygen.example", "free-crack-download.example", "malware-farm.example", "phishing-login.example", "win-free-prize.example", "free-prize-bonus.example", "crypto-bonus-win.example",
    )] + [(f"http://{host}/", 0) for host in (
        "city-news.example", "world-news-daily.example", "weather-report.example", "public-library.example", "city-library.example", "high-school.example", "state-university.example", "science-museum.example",
        "history-museum.example", "garden-club.example", "home-garden.example", "food-recipes.example", "family-recipes.example", "travel-guide.example", "mountain-travel.example", "bike-shop.example",
        "book-shop.example", "open-source-code.example", "code-review-blog.example", "photo-blog.example", "music-school.example", "town-council.example", "health-center.example", "medical-journal.example",
        "law-review.example", "sports-news.example", "football-club.example", "chess-club.example", "art-gallery.example", "bird-watching.example", "river-watch.example", "fire-station.example", "train-times.example",
        "bus-travel.example", "stone-bridge-inn.example", "farm-market.example", "open-data-portal.example", "research-center.example", "language-course.example", "free-library.example",
    )] + [("http://example/casino/bonus", 1), ("http://example/poker/win", 1), ("http://example/adult/cams", 1), ("http://example/pills/cheap", 1), ("http://example/ads/click", 1),
          ("http://example/news/world", 0), ("http://example/recipes/food", 0), ("http://example/blog/travel", 0), ("http://example/about/history", 0), ("http://example/library/books", 0)]
)


def runs(url: Column) -> Column:
    """[(side, run)]: the runs of letters, of any script, of a URL's host ('h') and of what follows it ('p'), in lower case, escapes decoded."""
    rest = F.lower(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.lower(F.coalesce(F.try_url_decode(path), path))
    of = lambda side, text: F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), lambda r: F.struct(F.lit(side).alias("side"), r.alias("run")))
    return F.concat(of("h", host), of("p", path))


def unigrams(pages: DataFrame, html: str = "html", names: DataFrame | None = None) -> DataFrame:
    """word, n over the visible words of all pages, of any script, and over those of the hosts and paths of `names` (url).

    The URLs of the pages don't count, or each joined name would be its own word.
    """
    words = F.regexp_extract_all(F.lower(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")), F.lit(r"\p{L}+"), F.lit(0))
    rows = pages.select(F.explode(words).alias("word"))
    if names is not None:
        rows = rows.unionByName(names.select(F.explode(runs(F.col("url"))["run"]).alias("word")))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_splits(sizes: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, n: np.ndarray, total: float) -> list[np.ndarray]:
    """Where the words of each run begin, in the likeliest split of all runs at once.

    sizes: letters of each run. row, start, length, n: substrings that are
    words, with their counts. An unknown word of m letters has probability
    UNKNOWN / (total * PER_LETTER ** m). Of equally likely splits the one with
    the longer last word wins.
    """
    most, base = int(sizes.max(initial=0)), float(np.log(total))
    best = np.full((len(sizes), most + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((len(sizes), most + 1), np.int32)
    # an unknown stretch that ends here: its likelihood and its begin
    open_, opened = np.full(len(sizes), -np.inf), np.zeros(len(sizes), np.int32)
    end = start + length
    order = np.lexsort((length, end))
    row, start, length, end, gain = row[order], start[order], length[order], end[order], np.log(n[order]) - base
    edge = np.searchsorted(end, np.arange(most + 2))
    for e in range(1, most + 1):
        fresh = best[:, e - 1] + np.log(UNKNOWN / PER_LETTER) - base
        open_ -= np.log(PER_LETTER)
        longer = open_ >= fresh - 1e-9
        open_, opened = np.where(longer, open_, fresh), np.where(longer, opened, e - 1).astype(np.int32)
        best[:, e], back[:, e] = open_, opened
        at = slice(edge[e], edge[e + 1])
        r, s = row[at], start[at]
        p = best[r, s] + gain[at]
        # of each run's words that end here the likeliest, of equals the longest
        pick = np.lexsort((-s, np.round(p, 9), r))
        last = np.flatnonzero(np.append(np.diff(r[pick]) != 0, True)) if len(pick) else pick
        r, s, p = r[pick[last]], s[pick[last]], p[pick[last]]
        wins = (p > best[r, e] + 1e-9) | ((np.abs(p - best[r, e]) <= 1e-9) & (s <= back[r, e]))
        best[r[wins], e], back[r[wins], e] = p[wins], s[wins]
    out = []
    for i, size in enumerate(sizes.tolist()):
        cuts = []
        while size:
            size = int(back[i, size])
            cuts.append(size)
        out.append(np.array(cuts[::-1], np.int64))
    return out


def segmented(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """run, words for each row of `distinct` (run), given (word, n)."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    n = F.length("run")
    start = distinct.select("run", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    subs = start.select("run", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), n - F.col("s") + 1))).alias("m"))
    hits = subs.withColumn("word", F.substring(F.col("run"), F.col("s"), F.col("m"))).join(counts, "word")
    grouped = hits.groupBy("run").agg(F.collect_list(F.struct((F.col("s") - 1).alias("s"), "m", "n")).alias("hits"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            order = np.argsort([len(x) for x in names], kind="stable")
            words: list = [None] * len(names)
            low = 0
            while low < len(order):  # runs of about one length together, in tables of at most some MB
                high = low + 1
                while high < len(order) and (high + 1 - low) * (len(names[order[high]]) + 1) <= 1 << 19:
                    high += 1
                pick = order[low:high]
                low = high
                lists = batch.column(1).take(pa.array(pick)).fill_null([])
                at = lists.offsets.to_numpy()
                parts = lists.flatten().flatten()
                s, m, k = (p.to_numpy().astype(np.int64) for p in parts)
                cuts = best_splits(np.array([len(names[i]) for i in pick]), np.repeat(np.arange(len(pick)), np.diff(at)), s, m, k.astype(float), total)
                for i, c in zip(pick, cuts):
                    words[i] = [names[i][a:b] for a, b in zip(c, [*c[1:], len(names[i])])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    return distinct.join(grouped, "run", "left").select("run", "hits").mapInArrow(split, "run string, words array<string>")


def url_words(urls: DataFrame, counts: DataFrame, url: str = "url") -> DataFrame:
    """url, words: each distinct non-NULL URL with the words of all its letter runs, in order, marked `h:` or `p:`."""
    distinct = urls.select(F.col(url).alias("url")).dropna().distinct()
    placed = distinct.select("url", F.posexplode_outer(runs(F.col("url"))).alias("at", "r")).select("url", "at", "r.side", "r.run")
    split = segmented(placed.select("run").dropna().distinct(), counts)
    marked = F.transform("words", lambda w: F.concat("side", F.lit(":"), w))
    ordered = F.array_sort(F.collect_list(F.when(F.col("words").isNotNull(), F.struct("at", marked.alias("words")))))
    return placed.join(split, "run", "left").groupBy("url").agg(F.flatten(F.transform(ordered, lambda x: x["words"])).alias("words"))


def weights(words: DataFrame, labels: DataFrame, alpha: float = 1.0) -> tuple[DataFrame, float]:
    """((word, weight), prior): naive Bayes log-odds from (url, words) and (url, blocked).

    Every labelled row counts, repeated ones too; NULL labels and URLs don't.
    With one class alone there are no weights and the prior is that of no
    evidence against, so that nothing is blocked.
    """
    rows = labels.select("url", F.col("blocked").cast("int").alias("y")).dropna().groupBy("url", "y").agg(F.count(F.lit(1)).alias("n"))
    seen = {r.y: r.n for r in rows.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    if len(seen) < 2:
        return words.sparkSession.createDataFrame([], "word string, weight double"), -20.0
    one = F.when(F.col("y") == 1, F.col("n")).otherwise(0)
    tokens = rows.join(words, "url").select(F.explode("words").alias("word"), one.alias("bad"), (F.col("n") - one).alias("good"))
    counts = cut_lineage(tokens.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    t = counts.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("v")).first()
    if not t.v:
        return words.sparkSession.createDataFrame([], "word string, weight double"), float(np.log(seen[1] / seen[0]))
    weight = F.log((F.col("bad") + alpha) / (t.bad + alpha * t.v)) - F.log((F.col("good") + alpha) / (t.good + alpha * t.v))
    return counts.select("word", weight.alias("weight")), float(np.log(seen[1] / seen[0]))


def addresses(spark: SparkSession) -> DataFrame:
    """url, blocked of ADDRESSES."""
    return spark.createDataFrame(list(ADDRESSES), "url string, blocked int")


def score(pages: DataFrame, labels: DataFrame | None = None, threshold: float = 0.0, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """`key`, url, words, score (log-odds), blocked of every row of `pages`.

    labels: (url, blocked 0/1), ADDRESSES by default; their words count among
    the unigrams. Letters of any script make words, percent escapes in paths are
    decoded, digits and signs part words. URLs of any length are split whole; a
    word that no label has says nothing. A URL is scored once however many rows
    have it; a NULL URL has NULL words and score and isn't blocked, one without
    letters has the prior's score; NULL pages count no words; repeated rows and
    ids come back each; other columns are ignored; an empty table gives no rows.
    """
    labels = (addresses(pages.sparkSession) if labels is None else labels).select("url", "blocked")
    counts = cut_lineage(unigrams(pages, html, labels))
    both = pages.select(F.col(url).alias("url")).unionByName(labels.select("url"))
    words = cut_lineage(url_words(both, counts))
    trained, prior = weights(words, labels)
    summed = words.select("url", F.explode("words").alias("word")).join(trained, "word").groupBy("url").agg(F.sum("weight").alias("w"))
    scored = words.join(summed, "url", "left").select(F.col("url").alias("_u"), "words", (F.coalesce("w", F.lit(0.0)) + prior).alias("score"))
    rows = pages.select(F.col(key), F.col(url).alias("url")).join(scored, F.col("url") == F.col("_u"), "left").drop("_u")
    return rows.withColumn("blocked", F.coalesce(F.col("score") > threshold, F.lit(False)))
