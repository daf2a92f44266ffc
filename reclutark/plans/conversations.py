"""Assistant conversations: recent messages and JSON replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from reclutark.functions import text


def last_messages(messages: DataFrame, kept: int = 10, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last messages of each conversation.

    Spark limits every group before the shuffle (rank filter), so one very long conversation stays small.
    """
    recent = Window.partitionBy(by).orderBy(F.desc(order))
    return messages.withColumn("_lugar", F.row_number().over(recent)).where(F.col("_lugar") <= kept).drop("_lugar")


#: Lets a parsed object name a field twice; the last one counts.
_REPEATED_NAMES = "spark.sql.variant.allowDuplicateKeys"


def payloads(replies: DataFrame, column: str = "texto", default: str = "He procesado tu solicitud.", bodies: bool = True) -> DataFrame:
    """Replies with the JSON object they carry (NULL if none), the answer to show and the chart, if any.

    A text that is not JSON from end to end carries nothing.  An object nested as text in the ``output`` field is taken instead
    of the outer one; an ``output`` that is an object itself is not unpacked.  Where an object repeats a name, the last one counts.  If the column
    holds ``bodies`` of replies, the first element of a list counts; of a mere text that looks like a list nothing is unpacked.  One
    projection per step, so that no text is searched or parsed twice.
    """
    conf = replies.sparkSession.conf
    before = conf.get(_REPEATED_NAMES)
    conf.set(_REPEATED_NAMES, "true")  # the parser takes it over when the columns are made
    try:
        return _payloads(replies, column, default, bodies)
    finally:
        conf.set(_REPEATED_NAMES, before)


def _payloads(replies: DataFrame, column: str, default: str, bodies: bool) -> DataFrame:
    reply = text.first_of_list(F.col(column)) if bodies else F.col(column)
    carried = (
        replies.withColumn("_cuerpo", text.json_body(reply))
        .withColumn("_valor", text.parsed_json(F.col("_cuerpo")))
        .withColumn("_interno", text.json_body(text.text_of(F.col("_valor"), "$.output")))
        .withColumn("_dentro", text.parsed_json(F.col("_interno")))
        .withColumn("contenido", F.when(F.col("_dentro").isNotNull(), F.col("_interno")).when(F.col("_valor").isNotNull(), F.col("_cuerpo")))
        .withColumn("_dado", F.coalesce("_dentro", "_valor"))
        .drop("_cuerpo", "_valor", "_interno", "_dentro")
    )
    # Text is taken from the parsed value; anything else is shown as it is written, and only a repeated name needs the parsed one.
    answer = F.coalesce(text.text_of(F.col("_dado"), "$.output"), text.written(F.col("contenido"), F.col("_dado"), "output"), F.lit(default))
    chart = F.coalesce(text.text_of(F.col("_dado"), "$.chart"), text.written(F.col("contenido"), F.col("_dado"), "chart"))
    shown = {"respuesta": F.when(F.col("contenido").isNotNull(), answer).otherwise(F.col(column)), "grafica": chart}
    return carried.withColumns(shown).drop("_dado")
