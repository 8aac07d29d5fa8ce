"""Boolean queries: lexer, parser, printer, and two independent plans.

Grammar: ``or := and ('|' and)*``, ``and := not ('&' not)*``, ``not := '!' not | '(' or ')' | word``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QueryParseError(ValueError):
    """The query doesn't follow the grammar."""


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Not:
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


def tokenize(query: str) -> list[str]:
    """Words (lower-cased), brackets and operators; all else separates."""
    return re.findall(r"\w+|[()&|!]", query.lower())


def parse(query: str):
    tokens, at = tokenize(query), 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def chain(op: str, part):
        left = part()
        while peek() == op:
            take()
            left = Binary(op, left, part())
        return left

    def unary():
        x = peek()
        if x is None or x in "&|)":
            raise QueryParseError(f"operand expected in {query!r}")
        take()
        if x == "!":
            return Not(unary())
        if x != "(":
            return Term(x)
        inner = disjunction()
        if peek() != ")":
            raise QueryParseError(f"bracket not closed in {query!r}")
        take()
        return inner

    def conjunction():
        return chain("&", unary)

    def disjunction():
        return chain("|", conjunction)

    tree = disjunction()
    if peek() is not None:
        raise QueryParseError(f"unexpected {peek()!r} in {query!r}")
    return tree


def show(node, top: bool = True) -> str:
    """Canonical form: every inner binary operation in brackets."""
    if isinstance(node, Term):
        return node.word
    if isinstance(node, Not):
        return "!" + show(node.arg, False)
    text = f"{show(node.left, False)} {node.op} {show(node.right, False)}"
    return text if top else f"({text})"


def terms(node) -> list[str]:
    if isinstance(node, Term):
        return [node.word]
    if isinstance(node, Not):
        return terms(node.arg)
    return sorted({*terms(node.left), *terms(node.right)})


def evaluate(node, truth):
    """Value of a tree where ``truth(word)`` gives a leaf; works on bools, sets of flags and Columns alike."""
    if isinstance(node, Term):
        return truth(node.word)
    if isinstance(node, Not):
        return ~evaluate(node.arg, truth) if isinstance(truth(terms(node)[0]), Column) else not evaluate(node.arg, truth)
    left, right = evaluate(node.left, truth), evaluate(node.right, truth)
    return left & right if node.op == "&" else left | right


def search(posts: DataFrame, universe: DataFrame, query: str) -> DataFrame:
    """doc_ids that satisfy the query: one filtered scan of the postings and one aggregation.

    The universe is joined only if a document without any of the terms could satisfy it.
    """
    tree = parse(query)
    names = {w: f"t{i}" for i, w in enumerate(terms(tree))}
    flags = posts.where(F.col("term").isin(list(names))).groupBy("doc_id").agg(*[F.max(F.col("term") == w).alias(c) for w, c in names.items()])
    if evaluate(tree, lambda w: False):
        flags = universe.select("doc_id").distinct().join(flags, "doc_id", "left").na.fill(False, list(names.values()))
    return flags.where(evaluate(tree, lambda w: F.col(names[w]))).select("doc_id")


def search_sets(posts: DataFrame, universe: DataFrame, query: str) -> DataFrame:
    """The same result from set operations, as a check on the plan above."""

    def run(node) -> DataFrame:
        if isinstance(node, Term):
            return posts.where(F.col("term") == node.word).select("doc_id").distinct()
        if isinstance(node, Not):
            return universe.select("doc_id").distinct().join(run(node.arg), "doc_id", "left_anti")
        left, right = run(node.left), run(node.right)
        return left.intersect(right) if node.op == "&" else left.union(right).distinct()

    return run(parse(query))


def search_many(posts: DataFrame, universe: DataFrame, queries: list[str]) -> DataFrame:
    """(query, doc_id) of several queries from one aggregation over the union of their terms."""
    trees = {q: parse(q) for q in queries}
    names = {w: f"t{i}" for i, w in enumerate(sorted({w for t in trees.values() for w in terms(t)}))}
    flags = posts.where(F.col("term").isin(list(names))).groupBy("doc_id").agg(*[F.max(F.col("term") == w).alias(c) for w, c in names.items()])
    flags = universe.select("doc_id").distinct().join(flags, "doc_id", "left").na.fill(False, list(names.values()))
    met = F.array(*[F.when(evaluate(t, lambda w: F.col(names[w])), F.lit(q)) for q, t in trees.items()])
    return flags.select("doc_id", F.explode(F.array_compact(met)).alias("query")).select("query", "doc_id")


def with_urls(result: DataFrame, urls: DataFrame) -> DataFrame:
    """(doc_id, url) in ascending doc_id order."""
    return result.join(urls.select("doc_id", "url"), "doc_id").orderBy("doc_id")
