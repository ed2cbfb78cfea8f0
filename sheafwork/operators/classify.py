"""Types, tags, names and codes derived from a document's text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafwork.functions.text import LINE_BREAK, bind, collapse_spaces, is_title, is_upper, keep_first, strip
from sheafwork.operators.listing import literal_map

UNKNOWN = "Unknown"
# Document types in order, each with the words that decide for it.
KEYWORDS = {
    "Invoice": ["invoice", "factura", "bill", "recibo"],
    "Contract": ["contract", "contrato", "agreement", "acuerdo"],
    "Receipt": ["receipt", "recibo", "ticket", "comprobante"],
    "Estimate": ["presupuesto", "estimate", "cotización", "quote"],
    "Report": ["report", "informe", "memo", "informe"],
    "Letter": ["dear", "estimado", "letter", "carta"],
    "Technical Plan": ["plano", "drawing", "scheme", "esquema", "blueprint", "diagrama", "technical drawing"],
}
# Labels of the visual classifier and the types they stand for.
VISUAL_TYPES = {
    "factura": "Invoice", "recibo": "Receipt", "contrato": "Contract", "informe": "Report", "carta": "Letter",
    "mueble": "Imagen", "decoracion": "Imagen",
}
VISUAL_DEFAULT = "Imagen"
LOW_CONFIDENCE = 0.6
VISUAL_SCORE = 0.7
# Project code patterns in order.
PROJECT_PATTERNS = (r"PRJ-[A-Z0-9]+", r"H-\d{4}", r"PROYECTO\s+[A-Z0-9]+")
ILLEGAL_IN_NAMES = r'[<>:"/\\|?*]'
# Scale patterns in order, and the denominators accepted.
SCALE_PATTERNS = (r"\bE\s?[:=]\s?1[:/](\d+)", r"\bEscala\s?1[:/](\d+)", r"\bScale\s?1[:/](\d+)", r"\b1[:/](\d+)\b")
DENOMINATORS = (10, 20, 50, 100, 200, 500, 1000)
# Area patterns.
AREA_PATTERNS = (r"(\d+[.,]\d{1,2})\s?(?:m²|m2|sq\s?m)", r"S\.?\s?(?:const|bhu)?[:\.]?\s?(\d+[.,]\d{1,2})")
# Rooms and their synonyms.
ROOMS = {
    "Cocina": ["cocina", "kitchen", "cocina-comedor", "kitchenette"],
    "Baño": ["baño", "aseo", "bath", "bathroom", "toilet", "wc"],
    "Dormitorio": ["dormitorio", "habitación", "alcoba", "bedroom", "room"],
    "Salón": ["salón", "sala", "living", "comedor", "lounge", "estar"],
    "Entrada": ["entrada", "hall", "vestíbulo", "recibidor", "foyer"],
    "Pasillo": ["pasillo", "distribuidor", "corridor", "hallway"],
    "Terraza": ["terraza", "balcón", "terrace", "balcony"],
    "Lavadero": ["lavadero", "tendedero", "laundry", "utility"],
    "Trastero": ["trastero", "storage"],
    "Garaje": ["garaje", "garage", "aparcamiento"],
}
# Advice per tag, and the tip when there is colour but no wood.
ADVICE = {
    "Madera Oscura": "Combina con tonos crema o textiles claros para dar luminosidad.",
    "Madera Roble (Oak)": "Va perfecto con verdes naturales y tonos tierra.",
    "Estilo Industrial": "Añade calidez con plantas y textiles suaves.",
    "Estilo Nórdico": "Mantén la paleta neutra y añade texturas naturales.",
    "Tela Terciopelo": "Aporta sofisticación. Evita recargar con demasiados estampados.",
    "Color Azul Marino": "Contrasta genial con mostaza o dorado.",
    "Color Verde Esmeralda": "Combina con maderas oscuras y latón.",
    "Color Terracota": "Ideal para ambientes rústicos o bohemios. Usa madera natural.",
    "Estilo Minimalista": "Menos es más. Añade una sola pieza de arte grande.",
}
WOOD_TIP = "🎨 Tip: Introduce elementos de madera para dar calidez al color."


def classify_keywords(text: Column, keywords: Mapping[str, Sequence[str]] = KEYWORDS) -> Column:
    """struct(type, tag): the first type in order with a word in the text, and that word."""
    def decide(lowered: Column) -> Column:
        choice = None
        for doc_type, words in keywords.items():
            for word in words:
                hit = F.struct(F.lit(doc_type).alias("type"), F.lit(word).alias("tag"))
                found = lowered.contains(word.lower())
                choice = F.when(found, hit) if choice is None else choice.when(found, hit)
        unknown = F.struct(F.lit(UNKNOWN).alias("type"), F.lit(None).cast("string").alias("tag"))
        return unknown if choice is None else choice.otherwise(unknown)

    return bind(F.lower(F.coalesce(text, F.lit(""))), decide)


def percent_tag(label: Column, score: Column) -> Column:
    return F.concat(label, F.lit(" ("), (score * 100).cast("int").cast("string"), F.lit("%)"))


def classify_with_fallback(type_: Column, confidence: Column, visual: Column, label: Column, score: Column) -> Column:
    """struct(type, tag): the visual classifier's top label replaces an unknown or unsure type when it scores above 0.7.

    ``visual`` says whether the file is an image or PDF; such a file never stays unknown.
    """
    use = visual & ((type_ == UNKNOWN) | (confidence < LOW_CONFIDENCE)) & F.coalesce(score > VISUAL_SCORE, F.lit(False))
    chosen = F.when(use, F.coalesce(literal_map(VISUAL_TYPES)[label], F.lit(UNKNOWN))).otherwise(type_)
    final = F.when((chosen == UNKNOWN) & visual, VISUAL_DEFAULT).otherwise(chosen)
    tag = F.when(use, F.concat(F.lit("VisualClass: "), percent_tag(label, score)))
    return F.struct(final.alias("type"), tag.alias("tag"))


def is_heading(line: Column) -> Column:
    """Short and all capitals or ending with a colon, or at most six title-case words."""
    words = F.size(F.regexp_extract_all(line, F.lit(r"(?U)\S+"), F.lit(0)))
    return (F.length(line) > 2) & (
        ((F.length(line) < 100) & (is_upper(line) | line.endswith(":"))) | ((words <= 6) & is_title(line))
    )


def to_markdown(text: Column) -> Column:
    """Lines to paragraphs and ``## `` headings, separated by one blank line.

    Blank lines and headings become line breaks inside one joined string, and runs of breaks collapse: no state is
    carried from line to line and the text never leaves its row.
    """
    def mark(line: Column) -> Column:
        return F.when(line == "", "\n").when(is_heading(line), F.concat(F.lit("\n## "), line, F.lit("\n"))).otherwise(
            collapse_spaces(line))

    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_BREAK), strip)
    joined = F.array_join(F.transform(lines, mark), " ")
    return strip(F.regexp_replace(joined, " *\n[ \n]*", "\n\n"))


def project_code(text: Column, patterns: Sequence[str] = PROJECT_PATTERNS) -> Column:
    """First pattern found, in capitals with dashes for spaces; null when none is."""
    hits = [F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit("")) for p in patterns]
    return F.replace(strip(F.upper(F.coalesce(*hits))), F.lit(" "), F.lit("-"))


def project_tag(text: Column) -> Column:
    return F.concat(F.lit("Project: "), project_code(text))


def tag_value(tags: Column, prefix: str, default: str) -> Column:
    """What follows ``prefix:`` in the first tag that starts with it."""
    first = keep_first(F.filter(tags, lambda t: t.startswith(f"{prefix}:")))
    return F.coalesce(strip(F.regexp_replace(first, f"^{prefix}:", "")), F.lit(default))


def smart_filename(date: Column, type_: Column, tags: Column, filename: Column) -> Column:
    """``{date}_{type}_{project}_{vendor}_{stem}``, illegal characters out, spaces as underscores, extension kept."""
    stem = F.regexp_replace(filename, r"(?<=[^.])\.[^.]*$", "")
    ext = F.regexp_extract(filename, r"[^.](\.[^.]*)$", 1)
    kind = F.when(type_ == UNKNOWN, "Doc").otherwise(type_)
    name = F.concat_ws("_", date, kind, tag_value(tags, "Project", "NoProject"), tag_value(tags, "Vendor", "NoVendor"),
                       stem)
    clean = F.replace(F.regexp_replace(name, ILLEGAL_IN_NAMES, ""), F.lit(" "), F.lit("_"))
    return F.concat(F.btrim(clean, F.lit("_")), ext)


def blueprint_scale(text: Column) -> Column:
    """``1:N`` from the first pattern whose first match has a standard denominator."""
    def candidate(pattern: str) -> Column:
        n = F.regexp_extract(text, f"(?i){pattern}", 1).try_cast("bigint")
        return F.when(n.isin(*DENOMINATORS), F.concat(F.lit("1:"), n))

    return F.coalesce(*[candidate(p) for p in SCALE_PATTERNS])


def blueprint_rooms(text: Column) -> Column:
    """Sorted room classes named by a whole word of the text."""
    def find(lowered: Column) -> Column:
        found = []
        for room, words in ROOMS.items():
            options = "|".join(words)
            found.append(F.when(lowered.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{options})(?![\p{{L}}\p{{N}}_])"), room))
        return F.array_sort(F.array_compact(F.array(*found)))

    return bind(F.lower(text), find)


def dedup_values(values: Column) -> Column:
    """Set semantics with a defined order."""
    return F.array_sort(F.array_distinct(values))


def blueprint_areas(text: Column) -> Column:
    """Distinct fragments that look like areas, sorted."""
    return dedup_values(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)) for p in AREA_PATTERNS]))


def decor_advice(tags: Column) -> Column:
    """Advice for the tags that have some, scores stripped; a tip when there is colour but no wood. Sorted set."""
    def advise(clean: Column) -> Column:
        hits = F.transform(clean, lambda t: F.concat(F.lit("💡 "), t, F.lit(": "), literal_map(ADVICE)[t]))
        tip = F.exists(clean, lambda t: t.contains("Color")) & ~F.exists(clean, lambda t: t.contains("Madera"))
        return dedup_values(F.array_compact(F.array_append(hits, F.when(tip, WOOD_TIP))))

    return bind(F.transform(tags, lambda t: strip(F.substring_index(t, "(", 1))), advise)


def merge_tags(tags: Column, scored: Column, colours: Column) -> Column:
    """Tags, then ``label (NN%)`` per scored label, then ``color:`` tags unless some are there already.

    ``scored``: array of struct(label, score).
    """
    named = F.concat(tags, F.transform(scored, lambda s: percent_tag(s["label"], s["score"])))
    coloured = F.concat(named, F.transform(colours, lambda c: F.concat(F.lit("color:"), c)))
    return F.when(F.exists(tags, lambda t: t.startswith("color:")), named).otherwise(coloured)
