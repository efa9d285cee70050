"""Operator 4: toxicity by Levenshtein automata over a lexicon trie.

1. Lexicon: over all labelled training rows, grouped counts of documents per
   term and label.  Terms are words and word stems (the first 4 or 5 letters).
   Those that lean to label 1 significantly are candidates, at any size of the
   corpus from the same ``SUPPORT`` on; a greedy cover of the rows of label 1 picks
   those that stand in rows which few others explain, so the chance words of one
   often copied document hardly enter.  The cover is fit on ``FIT_ROWS`` rows of
   label 1 at most, in the order of a hash; of the candidates that it left, all
   that still pass over all rows with few picked terms come in as well.
2. Match: every word of a text runs as an automaton with one edit (insertion,
   deletion, substitution) against the trie of lexicon words, so misspelled
   terms are caught, also those with digits or signs inside (id1ot, st*pid);
   stems match exactly.  A worker remembers words it has met.
3. Context: the words within ``SPAN`` of a match and quotation marks around it
   carry learned log-odds, which separate quoting from abuse.  Grouped counts
   per (term, distance) and per context word give those weights.
4. Score: logistic regression over the few evidence columns of a document.

Defined results: null or empty texts have no evidence and get the base score;
null ids and null labels are never learned from (a null id counts as held out);
repeated labels of one id count once (the larger); without any training row of
both labels every score is the share of label 1 among them, 0 if there is none.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import durable, remainder, stored, table

#: A term enters with at least so many training rows of label 1 ...
SUPPORT = 5
#: ... this log-odds for label 1 ...
LEAN = 2.0
#: ... and this likelihood ratio (chi-square, one degree; about one in a million by chance).
RATIO = 24.0
#: Rows of label 1 on which the cover is fit at most.
FIT_ROWS = 20_000
#: A row of label 1 asks for terms until so many of its own are in.
DEPTH = 4
#: A way of matching (a term at a distance) with less log-odds is no evidence;
#: one never met in training counts half of the term itself.
WEIGHT = 1.0
SPAN = 3
QUOTES = "\"'“”„«»‘’`"
WORD = re.compile(r"[^\W\d_]+")
#: Words that run on over inner digits and signs.
WIDE = re.compile(r"[^\W\d_]+(?:[\d*@$!#%&+_|]{1,2}[^\W\d_]+)*")
#: Stretches of text over whose borders no word goes; for ASCII texts all else becomes a space.
STRETCH = re.compile(r"[\w*@$!#%&+|]+")
APART = {i: " " for i in range(128) if not STRETCH.match(chr(i))}
EVIDENCE = ["best", "total", "matches", "quoted"]


def label_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, n1, n0) of rows (key, toxic)."""
    return rows.groupBy(key).agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))


def lean(n1: Column, n0: Column, all1: int, all0: int) -> Column:
    """Smoothed log-odds of label 1 against the labels' totals."""
    return F.log((n1 + 0.5) / (all1 + 1.0)) - F.log((n0 + 0.5) / (all0 + 1.0))


def ratio(n1: Column, n0: Column, all1: int, all0: int) -> Column:
    """Log-likelihood ratio of a term's rows against the labels' totals."""
    part = lambda n, of: F.when(n > 0, n * F.log(n / ((n1 + n0) * F.lit(of / (all1 + all0))))).otherwise(0.0)
    rest = lambda n, of: F.when(n < of, (of - n) * F.log((of - n) / ((all1 + all0 - n1 - n0) * F.lit(of / (all1 + all0))))).otherwise(0.0)
    return 2 * (part(n1, all1) + part(n0, all0) + rest(n1, all1) + rest(n0, all0))


class Trie:
    """Lexicon words with the positions of their ends."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        # By a word's length: the halves of which one is left whole by one edit.
        halves: dict[int, dict[tuple[bool, int], set[str]]] = {}
        for t in terms:
            half = len(t) // 2
            for n in (len(t) - 1, len(t), len(t) + 1):
                some = halves.setdefault(n, {})
                some.setdefault((True, half), set()).add(t[:half])
                some.setdefault((False, len(t) - half), set()).add(t[half:])
        self.halves = {n: [(slice(k) if head else slice(max(0, n - k), None), found) for (head, k), found in some.items()] for n, some in halves.items()}

    def near(self, word: str) -> tuple[str, int] | None:
        """The closest term within one edit.  States of the automaton are
        (position in the word, edits); they walk the trie together.  One edit
        leaves the first or the second half of a term in place."""
        n = len(word)
        for part, some in self.halves.get(n, ()):
            if word[part] in some:
                break
        else:
            return None
        best = None
        todo = [(self.root, {(0, 0)})]
        while todo:
            node, states = todo.pop()
            closure = states | {(i + 1, 1) for i, e in states if e == 0 and i < n}  # a letter too many
            if (term := node.get("")) and (found := [e for i, e in closure if i == n]) and (best is None or min(found) < best[1]):
                best = (term, min(found))
                if best[1] == 0:
                    return best
            for c, child in node.items():
                if c:
                    step = {(i + 1, e) for i, e in closure if i < n and word[i] == c}
                    step |= {(i + 1, 1) for i, e in closure if e == 0 and i < n and word[i] != c}  # another letter
                    step |= {(i, 1) for i, e in closure if e == 0}  # a letter missing
                    if step:
                        todo.append((child, step))
        return best


class Matcher:
    def __init__(self, words: list[str], stems: list[str], most: int = 400_000):
        self.exact, self.stems = set(words), set(stems)
        # One edit of a short word is often another word; what it means is learned, as term/1.
        self.trie = Trie([w for w in words if len(w) >= 4])
        self.wide = Trie(words)
        self.most = most
        self.seen: set[str] = set()  # stretches of text that were looked at,
        self.hits: set[str] = set()  # those of them with a match,
        self.known: dict[str, str] = {}  # the words with one, and those that are read
        self.odd: set[str] = set()  # as the words between their digits and signs

    def word(self, w: str) -> str | None:
        """The matched term with its distance, as 'term/0', 'term/1' or 'stem*/0'."""
        if w in self.exact:
            return w + "/0"
        for n in (4, 5):
            if w[:n] in self.stems:
                return w[:n] + "*/0"
        plain = w.isalpha()
        if found := (self.trie if plain else self.wide).near(w) if len(w) >= 3 else None:
            return f"{found[0]}/{found[1]}"
        return None

    def may_match(self, lower: str) -> bool:
        """Whether any word of the text is a match: most texts hold none, and need no
        places.  A stretch is looked at once."""
        stretches = set(lower.translate(APART).split() if lower.isascii() else STRETCH.findall(lower))
        if len(self.seen) > self.most:
            self.seen, self.hits, self.known, self.odd = set(), set(), {}, set()
        new = stretches - self.seen
        self.seen |= new
        for stretch in new:
            if stretch.isalpha():
                if self.look(stretch):
                    self.hits.add(stretch)
                continue
            for w in WIDE.findall(stretch):
                if self.look(w):
                    self.hits.add(stretch)
                elif not w.isalpha():
                    # What is no term with its digits and signs is read as the words between them.
                    self.odd.add(w)
                    if any([self.look(p) for p in WORD.findall(w)]):
                        self.hits.add(stretch)
        return not self.hits.isdisjoint(stretches)

    def look(self, w: str) -> str | None:
        found = self.word(w)
        if found:
            self.known[w] = found
        return found

    def __call__(self, text: str | None) -> list[tuple[str, list[str], bool]]:
        """(match, context words, quoted) for every match of the whole text."""
        text = text or ""
        lower = text.lower()
        if not self.may_match(lower):
            return []
        known, odd = self.known, self.odd
        places = []
        for m in WIDE.finditer(lower):
            if m[0] in odd:
                places += WORD.finditer(lower, *m.span())
            else:
                places.append(m)
        tokens = [m[0] for m in places]
        spans = {i: places[i].span() for i, w in enumerate(tokens) if w in known}
        out = []
        for i, (a, b) in spans.items():
            context = tokens[max(0, i - SPAN) : i] + tokens[i + 1 : i + 1 + SPAN]
            out.append((known[tokens[i]], context, lower[a - 1 : a] in QUOTES and a > 0 or lower[b : b + 1] in QUOTES and b < len(lower)))
        return out


def evidence(matcher: Matcher, weights: dict[str, float], context: dict[str, float], quote: float):
    def score(text: str | None) -> tuple[float, float, float, float]:
        found = [(w, c, q) for m, c, q in matcher(text) if (w := weights.get(m, weights.get(m[:-1] + "0", 0.0) / 2)) >= WEIGHT]
        if not found:
            return 0.0, 0.0, 0.0, 0.0
        each = []
        for weight, around, quoted in found:
            turn = sum(context.get(w, 0.0) for w in around) / max(1, len(around))
            each.append(weight + max(-2.0, min(2.0, turn)) + quote * quoted)
        total = sum(each)
        return max(each), math.copysign(math.log1p(abs(total)), total), math.log1p(len(found)), sum(q for _, _, q in found) / len(found)

    return score


def training(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, toxic) of the labelled rows that may be learned from."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    marks = marks.where(remainder(F.col("_id"), folds) != 0)
    # Labels grow with the documents, so they are never broadcast: one plan at every size.
    return docs.join(marks.hint("merge"), docs[id_col] == marks["_id"]).select(F.coalesce(docs[text_col], F.lit("")).alias("text"), marks["toxic"])


def cover(rows: list[set[str]], terms: dict[str, int], least: float) -> list[str]:
    """Terms, each the one that stands in most rows with fewer than ``DEPTH``
    terms picked before it."""
    holders: dict[str, set[int]] = {}
    for i, row in enumerate(rows):
        for t in row:
            holders.setdefault(t, set()).add(i)
    todo = [(-len(h), -terms[t], t) for t, h in holders.items()]
    heapq.heapify(todo)
    picked: list[str] = []
    times: Counter = Counter()
    done: set[int] = set()
    while todo:
        n, support, t = heapq.heappop(todo)
        now = -len(holders[t] - done)
        if now > n:
            heapq.heappush(todo, (now, support, t))
        elif -n < least:
            break
        else:
            picked.append(t)
            times.update(holders[t] - done)
            done |= {i for i in holders[t] if times[i] >= DEPTH}
    return picked


def induce(train: DataFrame, n1: int, n0: int) -> tuple[list[str], list[str]]:
    """Words and stems of the lexicon."""
    words = train.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).where("length(w) >= 3")
    terms = words.select("toxic", F.explode(F.expr("array(w, if(length(w) > 4, concat(left(w, 4), '*'), null), if(length(w) > 5, concat(left(w, 5), '*'), null))")).alias("term"))
    counted = label_counts(terms.where("term is not null"), "term")

    def leaning(rows: DataFrame) -> DataFrame:
        a, b = F.col("n1"), F.col("n0")
        return rows.where((a >= SUPPORT) & (lean(a, b, n1, n0) >= LEAN) & (ratio(a, b, n1, n0) >= RATIO))

    top = {r["term"]: (r["n1"], r["n0"]) for r in leaning(counted).orderBy(F.desc("n1"), "term").collect()}
    support = {t: n for t, (n, _) in top.items()}
    most: dict[str, int] = {}  # support of the best word under a stem
    for t, n in support.items():
        if not t.endswith("*"):
            for k in (4, 5):
                most[t[:k]] = max(n, most.get(t[:k], 0))
    support = {t: n for t, n in support.items() if not t.endswith("*") or most.get(t[:-1], 0) < 0.8 * n}
    support = {t: n for t, n in support.items() if t.endswith("*") or not any(t[:k] + "*" in support for k in (4, 5))}

    def terms_of(text: str) -> list[str]:
        tokens = set(WORD.findall(text.lower()))
        tokens |= {w[:n] + "*" for w in tokens for n in (4, 5) if len(w) > n}
        return sorted(t for t in tokens if t in support)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"terms": [terms_of(text) for text in batch["text"]]})

    toxic = train.where("toxic = 1")
    sample = toxic.orderBy(F.xxhash64("text")).limit(FIT_ROWS).select("text").mapInPandas(held, "terms array<string>").toPandas()
    picked = cover([set(t) for t in sample["terms"]], support, SUPPORT)
    # Where the sample was all rows nothing is left that passes; the same steps run at every size.
    if len(picked) < len(support):
        chosen = set(picked)

        def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out: Counter = Counter()
                for text in batch["text"]:
                    found = set(terms_of(text))
                    if len(found & chosen) < DEPTH:
                        out.update(found - chosen)
                yield pd.DataFrame(list(out.items()), columns=["term", "n"])

        rest = toxic.select("text").mapInPandas(left, "term string, n long").groupBy("term").agg(F.sum("n").alias("n1"))
        rest = rest.join(counted.select("term", "n0"), "term")
        picked += [r["term"] for r in leaning(rest).orderBy(F.desc("n1"), "term").collect()]
    return [t for t in picked if not t.endswith("*")], [t[:-1] for t in picked if t.endswith("*")]


class Model:
    """What a fit learned: the terms that pass and the words around them, a
    part of the vocabulary, so it travels with the task."""

    def __init__(self, train: DataFrame):
        totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
        n1, n0 = totals.get(1, 0), totals.get(0, 0)
        self.base = n1 / (n1 + n0) if n1 + n0 else 0.0
        self.coefficients = None
        if not n1 or not n0:
            return
        words, stems = induce(train, n1, n0)
        self.matcher = matcher = Matcher(words, stems)

        def matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out: Counter = Counter()
                for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                    found = matcher(text)
                    for what in {("m", m) for m, _, _ in found} | {("c", w) for _, c, _ in found for w in c} | {("q", str(q)) for _, _, q in found}:
                        out[*what, toxic] += 1
                yield pd.DataFrame([(*k, n) for k, n in out.items()], columns=["kind", "what", "toxic", "n"])

        seen = train.mapInPandas(matches, "kind string, what string, toxic int, n long")
        seen = durable(seen.groupBy("kind", "what").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("n1"), F.sum(F.expr("if(toxic = 1, 0, n)")).alias("n0")))
        rows = seen.where("kind <> 'c' or n1 + n0 >= 5").orderBy(F.desc(F.col("n1") + F.col("n0")), "what").collect()
        odds = lambda r, a, b: math.log((r["n1"] + 0.5) / (a + 1)) - math.log((r["n0"] + 0.5) / (b + 1))
        self.weights = {r["what"]: odds(r, n1, n0) for r in rows if r["kind"] == "m"}
        m1 = sum(r["n1"] for r in rows if r["kind"] == "q") or 1
        m0 = sum(r["n0"] for r in rows if r["kind"] == "q")
        # against the other matches' contexts; pulled to 0 where there is little to tell
        self.context = {r["what"]: odds(r, m1, m0) * (r["n0"] / (r["n0"] + 5)) for r in rows if r["kind"] == "c"}
        self.quote = next((odds(r, m1, m0) * (r["n0"] / (r["n0"] + 5)) for r in rows if r["kind"] == "q" and r["what"] == "True"), 0.0)
        self.fit(train)

    def fit(self, train: DataFrame) -> None:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        score = evidence(self.matcher, self.weights, self.context, self.quote)

        def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = pd.DataFrame([score(t) for t in batch["text"]], columns=EVIDENCE, dtype=float)
                yield out.assign(toxic=batch["toxic"].to_numpy()).value_counts().rename("n").reset_index()

        rows = train.mapInPandas(features, ", ".join(f"{c} double" for c in EVIDENCE) + ", toxic int, n long")
        rows = durable(rows.groupBy(*EVIDENCE, "toxic").agg(F.sum("n").cast("double").alias("n")))
        ready = VectorAssembler(inputCols=EVIDENCE, outputCol="features").transform(rows)
        fitted = LogisticRegression(labelCol="toxic", weightCol="n", regParam=1e-4, maxIter=50).fit(ready)
        self.coefficients = [float(x) for x in fitted.coefficients]
        self.intercept = float(fitted.intercept)

    def scores(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``docs`` with the column ``score``."""
        if self.coefficients is None:
            return docs.withColumn("score", F.lit(float(self.base)))
        score, coefficients, intercept = evidence(self.matcher, self.weights, self.context, self.quote), self.coefficients, self.intercept

        def one(text: str | None) -> float:
            z = intercept + sum(c * x for c, x in zip(coefficients, score(text), strict=True))
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))

        def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([one(t) for t in texts], dtype=float)

        udf = F.pandas_udf(apply, "double", F.PandasUDFType.SCALAR_ITER)
        return docs.withColumn("score", udf(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` with ``held_out`` and ``score``; learns from ``labels``."""
    # Fitting passes over the training rows five times; the join is made once.
    model = Model(stored(training(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col), "toxicity-training"))
    held = F.coalesce(remainder(F.col(id_col), 5) == 0, F.lit(True))
    return model.scores(docs.withColumn("held_out", held), id_col, text_col)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
