"""Routing decisions and order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW = 0.70
CRITICAL = 0.40
NATIVE = 0.9
COMPLEX_TYPES = ("plano", "boceto", "diagrama", "manuscrito")
# Actions and reasons of a routing decision.
CONTINUE, INVOKE = "continuar_pipeline_estandar", "invocar_modulo_interpretacion"
REASON_NATIVE = "Documento digital nativo con texto legible y alta confianza. OCR clásico suficiente."
REASON_HANDWRITING = "Escritura manual detectada. Requiere interpretación semántica."
REASON_MIXED = "Confianza media-baja con elementos gráficos. Posible documento mixto."
REASON_DEFAULT = "OCR clásico produjo resultados aceptables dentro de los umbrales."
REASON_INVALID = "Fallback por error: Error de validación"


def route_interpretation(requests: DataFrame) -> DataFrame:
    """Add ``decision``: struct(activate, action, reason, kind, confidence).

    Needs native_pdf, confidence, low_blocks, legible, handwriting, graphics, previous_type. Rules apply in order; a
    request with a missing value or one out of range gets the safe fallback.
    """
    c = F.col
    valid = F.coalesce(
        c("confidence").between(0.0, 1.0) & (c("low_blocks") >= 0) & c("native_pdf").isNotNull()
        & c("legible").isNotNull() & c("handwriting").isNotNull() & c("graphics").isNotNull()
        & c("previous_type").isNotNull(), F.lit(False))

    def answer(activate: bool, reason: Column, confidence: float, kind: str | None = None) -> Column:
        return F.struct(
            F.lit(activate).alias("activate"), F.lit(INVOKE if activate else CONTINUE).alias("action"),
            reason.alias("reason"), F.lit(kind).cast("string").alias("kind"), F.lit(confidence).alias("confidence"))

    by_type = F.concat(F.lit("Clasificación '"), c("previous_type"), F.lit("' requiere análisis visual avanzado."))
    critical = F.concat(F.lit("Confianza OCR crítica ("), F.format_string("%.2f", c("confidence")),
                        F.lit("). Posible imagen sin texto o ruido, o escritura ilegible."))
    decision = F.when(~valid, answer(False, F.lit(REASON_INVALID), 0.0)).when(
        c("native_pdf") & (c("confidence") > NATIVE) & c("legible"), answer(False, F.lit(REASON_NATIVE), 0.99)).when(
        c("handwriting"), answer(True, F.lit(REASON_HANDWRITING), 0.95, "manuscrito")).when(
        F.lower("previous_type").isin(*COMPLEX_TYPES), answer(True, by_type, 0.90, "visual_complex")).when(
        c("confidence") < CRITICAL, answer(True, critical, 0.85, "recuperacion_ruido")).when(
        (c("confidence") < LOW) & c("graphics"), answer(True, F.lit(REASON_MIXED), 0.75, "mixto")).otherwise(
        answer(False, F.lit(REASON_DEFAULT), 0.90))
    return requests.withColumn("decision", decision)


# Contents of order lines.
TAG_REFERENCE = "ETIQUETA"
SUPPLIER, PRICE, STATE = "A determinar", "Consultar", "Pendiente"
FROM_CROPS, FROM_TAGS = "Detección Visual", "Etiquetado Auto"
NOTHING_FOUND = "No se detectaron elementos específicos para listar."


def order_lines(items: DataFrame) -> DataFrame:
    """One row per thing to order: detected crops, else tags that are no system tags, else one placeholder.

    ``items``: doc_id, crops (array of struct(label), null when none were made), tags (array of strings).
    """
    def line(reference: Column, description: Column, origin: str | None) -> Column:
        known = origin is not None
        text = lambda v: F.lit(v if known else None).cast("string")
        return F.struct(
            reference.cast("string").alias("reference"), description.alias("description"),
            F.lit(1 if known else None).cast("bigint").alias("quantity"), text(SUPPLIER).alias("supplier"),
            text(PRICE).alias("price"), text(STATE).alias("state"), text(origin).alias("origin"))

    def from_crop(crop: Column) -> Column:
        short = F.upper(F.substring(F.coalesce(crop["label"], F.lit("Item")), 1, 3))
        reference = F.concat(F.lit("AUTO-"), short, F.lit("-"), F.col("doc_id"))
        return line(reference, F.coalesce(crop["label"], F.lit("Elemento Decorativo")), FROM_CROPS)

    plain = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda t: ~t.contains(":"))
    rows = F.when(F.col("crops").isNotNull(), F.transform("crops", from_crop)).otherwise(
        F.transform(plain, lambda t: line(F.lit(TAG_REFERENCE), t, FROM_TAGS)))
    placeholder = F.array(line(F.lit(None), F.lit(NOTHING_FOUND), None))
    return items.withColumn("_rows", rows).select(
        "doc_id", F.inline(F.when(F.size("_rows") > 0, F.col("_rows")).otherwise(placeholder)))
