"""Re-ranking as a Column: the twin that the Arrow form is tested against."""

from pyspark.sql import Column, functions as F

from marlpit.functions.vectors import SCORE_DECIMALS, dot, let, norm
from marlpit.operators.retrieval import RELEVANCE_WEIGHT


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays zero."""
    return let(
        norm(a),
        lambda length: F.transform(
            a,
            lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x.cast("double") / length),
        ),
    )


def mmr_picks(candidates: Column, k: int, relevance_weight: float = RELEVANCE_WEIGHT) -> Column:
    """Indices (0-based) of the maximal-marginal-relevance picks, in pick order.

    `candidates` is an array of structs with `score` and `embedding`, best
    first. Each pick maximizes weight * score - (1 - weight) * closeness, where
    closeness is the highest cosine to an earlier pick, at least 0; equal
    values go to the earlier candidate. Every candidate's closeness is kept in
    the state, so a round compares it with the newest pick only.
    """
    if k <= 0:
        return F.array().cast("array<int>")
    weight = F.lit(float(relevance_weight))

    def run(units: Column) -> Column:
        start = F.struct(
            F.array().cast("array<int>").alias("picks"),
            F.transform(candidates, lambda c: F.lit(0.0)).alias("closeness"),
        )

        def step(state: Column, _: Column) -> Column:
            def value(candidate: Column, i: Column) -> Column:
                gain = weight * candidate["score"]
                loss = (F.lit(1.0) - weight) * F.get(state["closeness"], i)
                return F.when(
                    ~F.array_contains(state["picks"], i),
                    F.struct(
                        F.round(gain - loss, SCORE_DECIMALS).alias("mmr"), (-i).alias("earlier")
                    ),
                )

            best = F.array_max(F.transform(candidates, value))
            return let(
                -best["earlier"],
                lambda pick: F.struct(
                    F.concat(state["picks"], F.array(pick)).alias("picks"),
                    F.transform(
                        state["closeness"],
                        lambda close, i: F.greatest(
                            close, dot(F.get(units, i), F.get(units, pick))
                        ),
                    ).alias("closeness"),
                ),
            )

        rounds = F.slice(F.sequence(F.lit(1), F.lit(k)), 1, F.size(candidates))
        return F.aggregate(rounds, start, step, lambda state: state["picks"])

    return let(F.transform(candidates, lambda c: unit(c["embedding"])), run)
