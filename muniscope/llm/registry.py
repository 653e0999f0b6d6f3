"""Queries of the corpus operators and the SQL for those that SQL can express."""

from . import chat, decontam, exact_dedup, html_extract, jaccard_join, license_scan, line_templates, periodic_runs, ring_shards, sentencepiece_codec, spelling_variants, toxicity, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_warc": warc.op2_warc,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op4_line_templates": line_templates.op4_line_templates,
        "op5_chat": chat.op5_chat,
        "op6_decontaminate": decontam.op6_decontaminate,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_html_extract": html_extract.op9_html_extract,
        "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
        "op11_ring_shards": ring_shards.op11_ring_shards,
        "op12_spelling_variants": spelling_variants.op12_spelling_variants,
        "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    }


def oracle_sql() -> dict:
    return {
        "op2_warc": warc.OP2_SQL,
        "op3_jaccard_join": jaccard_join.OP3_SQL,
        "op4_line_templates": line_templates.OP4_SQL,
        "op5_chat": chat.OP5_SQL,
        "op6_decontaminate": decontam.OP6_SQL,
        "op7_license_scan": license_scan.OP7_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
    }
