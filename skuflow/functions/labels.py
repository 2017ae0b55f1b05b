"""Text built for warehouse instructions.

Fixed values: the flow words, zone marks and sentence parts below are the output
format that consumers of the instructions already read; they are kept verbatim.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IN_WORDS = ["ingoing", "in", "entree", "reception", "incoming"]
OUT_WORDS = ["outgoing", "out", "sortie", "expedition", "outcoming"]

RECEIPT = (0, 0, 0)
EXPEDITION = (3, 5, 0)


def direction(word: Column | str) -> Column:
    """Flow word to in / out / unknown."""
    w = F.lower(F.trim(F.col(word) if isinstance(word, str) else word))
    return F.when(w.isin(IN_WORDS), "in").when(w.isin(OUT_WORDS), "out").otherwise("unknown")


def _zone_level(zone: Column) -> Column:
    return F.replace(zone, F.lit("B07-"), F.lit(""))


def zone_label() -> Column:
    """Path to a slot from its zone, floor, level and code."""
    zone, floor = F.col("zone"), F.col("floor")
    place = (
        F.when(F.contains(zone, F.lit("B7-PCK")), F.lit("Zone Picking B7"))
        .when(F.contains(zone, F.lit("B07-N")), F.concat(F.lit("Zone Reserve "), _zone_level(zone)))
        .when(F.contains(zone, F.lit("B07-SS")), F.lit("Zone Sous-sol Reserve"))
        .otherwise(F.concat(F.lit("Zone "), zone))
    )
    aisle = F.when(F.length(floor) > 0, F.concat(F.lit("Allee "), F.substring(floor, 1, 2)))
    level = F.when(F.col("z") > 0, F.format_string("Etage %d (acces lift)", "z")).otherwise(F.lit("RDC"))
    return F.concat_ws(" -> ", place, aisle, level, F.concat(F.lit("Emplacement "), F.col("code")))


def route_text(from_level: Column | int) -> Column:
    """Way from a level to a slot."""
    start = F.lit(from_level) if isinstance(from_level, int) else from_level
    z = F.col("z")
    change = F.when(z > start, F.format_string("Monter au niveau %d via lift", "z")).when(
        z < start, F.format_string("Descendre au niveau %d via lift", "z")
    )
    aisle = F.when(F.length("floor") > 0, F.concat(F.lit("Allee "), F.col("floor")))
    kind = F.when(F.contains(F.col("zone"), F.lit("PCK")), F.lit("(zone picking)")).when(
        F.contains(F.col("slot_type"), F.lit("RESERVE")), F.lit("(zone reserve)")
    )
    return F.concat_ws(" -> ", change, aisle, F.concat(F.lit("Se rendre a "), F.col("code")), kind)


def receipt_route() -> Column:
    return F.concat(F.lit("Reception -> "), route_text(RECEIPT[2]))


def expedition_route() -> Column:
    return F.concat(F.lit("Expedition -> "), route_text(EXPEDITION[2]), F.lit(" -> Retour Expedition"))


def instruction_route(way: Column | str) -> Column:
    """Short route by direction, for the instruction file."""
    way = F.col(way) if isinstance(way, str) else way
    zone = F.col("zone")
    picking, level, cellar = (F.contains(zone, F.lit(m)) for m in ("PCK", "B07-N", "B07-SS"))
    inner_in = (
        F.when(picking, F.lit("Zone Picking B7"))
        .when(level, F.concat(F.lit("Lift -> "), _zone_level(zone)))
        .when(cellar, F.lit("Lift -> Sous-sol"))
        .otherwise(zone)
    )
    inner_out = (
        F.when(picking, F.lit("Zone Picking B7"))
        .when(level, F.concat(_zone_level(zone), F.lit(" -> Lift")))
        .when(cellar, F.lit("Sous-sol -> Lift"))
        .otherwise(zone)
    )
    return F.when(way == "in", F.concat_ws(" -> ", F.lit("Reception"), inner_in, F.col("code"))).otherwise(
        F.concat_ws(" -> ", F.col("code"), inner_out, F.lit("Expedition"))
    )


def storage_reason() -> Column:
    """Why a slot was chosen: segment, frequency, type, distance, level, weight rule."""
    return F.concat_ws(
        "; ",
        F.concat(F.lit("Segment="), F.col("segment")),
        F.format_string("Freq=%.4f", "demand_freq"),
        F.concat(F.lit("Type="), F.col("slot_type")),
        F.concat(F.lit("Dist exp="), F.col("dist").cast("string")),
        F.format_string("Etage=%d", "z"),
        F.when(F.col("weight_kg") > 5, F.concat(F.lit("Lourd ("), F.col("weight_kg").cast("string"), F.lit("kg) -> sol"))),
    )


def storage_reason_short() -> Column:
    hf = F.col("segment") == "HF"
    return F.concat_ws(
        "; ",
        F.concat(F.lit("Segment="), F.col("segment")),
        F.when(hf, F.format_string("High freq (%.3f)", "demand_freq")).otherwise(
            F.format_string("Low freq (%.4f)", "demand_freq")
        ),
        F.when(hf, F.lit("Min distance to expedition")).otherwise(F.lit("Reserve storage")),
    )


def picking_reason_short() -> Column:
    return F.concat_ws(
        "; ",
        F.when(F.col("segment") == "HF", F.lit("High demand product")).otherwise(F.lit("Low frequency product")),
        F.format_string("Freq=%.4f", "demand_freq"),
    )


def picking_reason() -> Column:
    return F.format_string("Produit trouve en %s (segment=%s, freq=%.4f)", "code", "segment", "demand_freq")


NO_SLOT_REASON = "Tous les emplacements sont occupes"
NO_SLOT_ACTION = "Stockage impossible - pas d'emplacement disponible"
NO_SLOT_WARNING = "Entrepot plein"
STOCK_OUT_ACTION = "Produit non stocke - rupture de stock"
STOCK_OUT_WARNING = "Stock insuffisant"
UNKNOWN_ACTION = "Type de flux inconnu"


def stock_out_reason() -> Column:
    return F.format_string("Aucun emplacement trouve pour produit %d. Verifier approvisionnements.", "sku")


def unknown_warning(word: str) -> Column:
    return F.concat(F.lit("flow_type doit etre 'ingoing' ou 'outgoing', recu: '"), F.lower(word), F.lit("'"))
