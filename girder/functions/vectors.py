"""Vector and similarity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, without normalisation; empty gives 0."""
    n = F.least(F.size(a), F.size(b))
    cut = lambda x: F.transform(F.slice(x, 1, F.greatest(n, F.lit(0))), lambda v: v.cast("double"))
    return F.aggregate(F.zip_with(cut(a), cut(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def dense_score(a: Column, b: Column) -> Column:
    """Dot product, negatives to 0."""
    return F.greatest(F.lit(0.0), dot(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; null if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def profile_similarity(pairs: list[tuple[Column, Column]]) -> Column:
    """Mean Jaccard over the feature sets that are not both empty; 0 without any."""
    scores = F.array_compact(F.array(*(jaccard(a, b) for a, b in pairs)))
    return F.when(F.size(scores) == 0, 0.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x) / F.size(scores))


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Nothing relevant gives 1."""
    return F.when(F.size(relevant) == 0, 1.0).otherwise(F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)) / F.size(F.array_distinct(relevant)))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """1 over the place of the first relevant item, else 0."""
    places = F.filter(F.transform(retrieved, lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda p: p.isNotNull())
    return F.when(F.size(places) == 0, 0.0).otherwise(1.0 / F.array_min(places))


def dcg(gains: Column, k: int) -> Column:
    """Sum of (2**gain - 1) / log2(place + 1) over the first k gains, negatives as 0."""
    terms = F.transform(F.slice(gains, 1, k), lambda g, i: (F.pow(F.lit(2.0), F.greatest(F.lit(0.0), g)) - 1) / F.log2(i + 2))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def ndcg_at_k(gains: Column, all_gains: Column, k: int) -> Column:
    """No ideal gain gives 1."""
    ideal = dcg(F.sort_array(F.transform(all_gains, lambda g: F.greatest(F.lit(0.0), g)), asc=False), k)
    return F.when(ideal == 0, 1.0).otherwise(dcg(gains, k) / ideal)
