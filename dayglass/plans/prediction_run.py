"""The whole run: log -> features -> base models -> day-out scores -> stacked models -> blend -> final scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayglass.functions import scalar
from dayglass.operators import joins as G
from dayglass.operators import scoring as H
from dayglass.plans import models as J
from dayglass.roles import Roles
from dayglass.session import cut_lineage


#: First-level models whose scores the stacked models use.
FIRST_LEVEL = ("light", "hist")


def predict_next_day(
    log: DataFrame,
    roles: Roles,
    test_day: int,
    settings: dict[str, J.TreeSettings] = J.BASE_MODELS,
    label: str = "is_installed",
    preparation: J.Preparation = J.Preparation(),
) -> DataFrame:
    """(RowId, is_clicked, is_installed) for every row of ``test_day``.

    Three base models score the test day. Two of them also score every earlier day by models of all other days,
    which grow side by side; two stacked models learn from the features and both of these scores, and use the base
    models' scores on the test day. All scores are reranked to those of the first model and blended. For the raw log
    ``preparation`` is ``RAW_PREPARATION``.
    """
    row_id, day = roles.row_id, roles.day
    table, features = J.model_table(log, roles, label, preparation)
    base = {n: cut_lineage(s) for n, s in J.base_model_scores(table, features, row_id, day, test_day, label, settings, preparation).items()}
    reference = base["cat"]

    def reranked(scores: DataFrame) -> DataFrame:
        return cut_lineage(H.rerank(scores, reference, row_id, "score").select(row_id, F.col("is_installed").alias("score")))

    for name in FIRST_LEVEL:
        base[name] = reranked(base[name])
    days = J.days_before(table, day, test_day)

    def first_level(name: str) -> DataFrame:
        used = preparation.features(features, name)
        folds = J.day_out_model_scores(table, used, row_id, day, days, settings[name], label)
        return cut_lineage(folds.select(row_id, "score").unionByName(base[name]))

    scores = cut_lineage(G.join_scores(dict(zip(FIRST_LEVEL, J.side_by_side(first_level, FIRST_LEVEL))), row_id))

    def stacked(name: str) -> DataFrame:
        used = preparation.features(features, name)
        return reranked(J.stacked_scores(table, used, row_id, day, test_day, scores, list(FIRST_LEVEL), settings[name], label))

    second_level = dict(zip([f"{name}_hybrid" for name in FIRST_LEVEL], J.side_by_side(stacked, FIRST_LEVEL)))
    joined = G.join_scores({**base, **second_level}, row_id)
    blended = cut_lineage(H.weighted_blend(joined).select(row_id, "score"))
    final = H.rerank(blended, reference, row_id, "score")
    return final.select(
        F.col(row_id).alias("RowId"),
        "is_clicked",
        scalar.piecewise_rescale(F.col("is_installed")).alias("is_installed"),
    )
