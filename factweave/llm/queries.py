"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, iso_media, language, neardup, packing, private, quality, repeats, runs, token_counts, token_files, top_k, trie

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_quality": quality.op2_quality,
    "op3_packing": packing.op3_packing,
    "op4_token_files": token_files.op4_token_files,
    "op5_private": private.op5_private,
    "op6_repeats": repeats.op6_repeats,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_neardup": neardup.op8_neardup,
    "op9_media": iso_media.op9_media,
    "op10_language": language.op10_language,
    "op11_runs": runs.op11_runs,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_top_k": top_k.op13_top_k,
    # What SQL can express of op5 and op9.
    "private_base": private.base_private,
    "media_payload": iso_media.media_payload,
}

ORACLES = {"private_base": private.BASE_SQL, "media_payload": iso_media.PAYLOAD_SQL, "op6_repeats": repeats.OP6_SQL, "op7_decontaminate": decontaminate.OP7_SQL, "op8_neardup": neardup.OP8_SQL, "op12_prefix_trie": trie.OP12_SQL, "op13_top_k": top_k.OP13_SQL}
