"""From report texts to severity codes, and from confirmation reports to outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import severity as S
from ..functions import topics as T
from ..functions.text import report_key, strip_prefixed_lines, strip_signature_blocks, text_hash
from ..operators.relational import first_row


def coded_reports(reports: DataFrame, text: str, visit: str) -> DataFrame:
    """Extract, refine and normalise codes; off-topic reports without a code drop out.

    One row per (visit, text hash); expects no null text.
    """
    found = reports.withColumn("raw_text_hash", text_hash(F.col(text))).withColumn("_f", S.extract_value(F.col(text)))
    # The topic score is only needed where no code was found.
    topic = F.when(F.col("_f").isNull(), T.topic_score(F.col(text)))
    coded = (
        found.withColumn("_on", topic["on_topic"])
        .where(F.coalesce("_on", F.lit(True)))
        .withColumn("value", S.refine_zero(F.col("_f.value"), F.col("_f.clause")))
        .withColumn("code", S.normalize_code(F.col("value")))
        .drop("_f", "_on")
    )
    return first_row(coded, [visit, "raw_text_hash"])


def confirmation_reports(reports: DataFrame, links: DataFrame, *, visit: str, entity: str, text: str) -> DataFrame:
    """Topic reports, deduplicated, scored for kind of report and linked to persons.

    ``links`` maps ``entity`` to ``person_id``.
    """
    keyed = reports.where(F.col(text).isNotNull()).withColumn("raw_text_hash", text_hash(F.col(text)))
    one = first_row(keyed, [visit, entity, "raw_text_hash"])
    folded = T.folded(F.col(text))
    scored = (
        one.withColumn("on_topic", T.keyword_flag(F.col(text)))
        .where(F.col("on_topic"))
        .withColumn("procedure_points", T.procedure_points(folded))
        .withColumn("screening_points", T.screening_points(folded))
        .withColumn("point_difference", F.col("procedure_points") - F.col("screening_points"))
        .withColumn("kind", T.two_class_label(F.col("procedure_points"), F.col("screening_points")))
        .withColumn("key", report_key(F.col(visit), F.col(text)))
    )
    return scored.join(links.select(entity, "person_id").distinct(), entity, "left")


def report_outcomes(reports: DataFrame, key: str, text: str, done: DataFrame | None = None) -> DataFrame:
    """Outcome label per report by the stated rules; keys already labelled are skipped.

    A model of the user's own can replace the rule column by ``mapInPandas``.
    """
    todo = reports if done is None else reports.join(done.select(key), key, "left_anti")
    cleaned = strip_prefixed_lines(strip_signature_blocks(F.col(text)))
    return todo.select(key, T.outcome_rules(cleaned).alias("content"))
