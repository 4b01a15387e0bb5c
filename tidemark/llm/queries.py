"""One query for each operator, over its whole table."""

from __future__ import annotations

from . import chat, fingerprints, language_id, licenses, media, mixing, packing, simhash_dedup, suffix_dedup, url_filters
from .common import table


def _over(name: str, digest):
    return lambda spark, sf_dir: digest(table(spark, sf_dir, name))


QUERIES = {
    "op1_packing": _over("documents", packing.digest),
    "op2_suffix_dedup": _over("documents", suffix_dedup.digest),
    "op3_fingerprints": _over("documents", fingerprints.digest),
    "op4_language_id": _over("documents", language_id.digest),
    "op5_licenses": _over("documents", licenses.digest),
    "op6_simhash_dedup": _over("documents", simhash_dedup.digest),
    "op7_mixing": _over("documents", mixing.digest),
    "op8_chat": _over("conversations", chat.digest),
    "op9_media": _over("documents", media.digest),
    "op10_url_filters": lambda spark, sf_dir: url_filters.digest(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")),
    # of three operators, what SQL can say
    "mixing_targets": _over("documents", mixing.target_rows),
    "media_payloads": _over("documents", media.payload_rows),
    "url_fixed_rules": _over("pages", url_filters.fixed_rows),
}
ORACLE = {"op5_licenses": licenses.ORACLE, "op8_chat": chat.ORACLE, "op10_url_filters": url_filters.ORACLE, "mixing_targets": mixing.TARGETS, "media_payloads": media.PAYLOADS, "url_fixed_rules": url_filters.FIXED}
