"""Queries of this subpackage: one for each operator, and the pipeline."""

from __future__ import annotations

from . import bitplane, bpe, chunk_dedup, decontaminate, language, minhash, pii, simhash, suffix_dedup, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_token_bitplanes": bitplane.op1_token_bitplanes,
        "op2_chunk_dedup": chunk_dedup.op2_chunk_dedup,
        "op3_minhash": minhash.op3_minhash,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_pii": pii.op5_pii,
        "op6_language": language.op6_language,
        "op7_simhash": simhash.op7_simhash,
        "op8_bpe": bpe.op8_bpe,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_warc": warc.op10_warc,
        "pipeline": corpus_pipeline.run,
    }


def _base32(hexed: str) -> str:
    """DuckDB's expression for the base 32 of 40 hexadecimal digits: five bits of each ten digits at a time."""
    part = "('0x' || substr({h}, {at}, 10))::BIGINT"
    return " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({part.format(h=hexed, at=10 * j + 1)}) >> {35 - 5 * k}) & 31)::INT + 1, 1)" for j in range(4) for k in range(8))


#: Records follow from the pages alone: equal payloads have one response, the largest page_id.
_WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h FROM pages), k AS (SELECT *, max(page_id) OVER (PARTITION BY h) keeper FROM p)
 SELECT page_id, strlen(html)::BIGINT payload_bytes, {_base32('h')} payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END record_type, CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END refers_to FROM k"""

#: Strings of 200 bytes as 400 hexadecimal digits, taken from overlapping pieces of each text; those that start twice cover bytes.
_SUFFIX = """WITH d AS (SELECT row_number() OVER () r, doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
 pieces AS (SELECT r, b, substr(h, 2 * b + 1, 2398) piece FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199, 1000)) b FROM d WHERE length(h) >= 400)),
 starts AS (SELECT r, b + i pos, md5_number(substr(piece, 2 * i + 1, 400)) s FROM (SELECT r, b, piece, unnest(range(0, least(1000, length(piece) // 2 - 199))) i FROM pieces)),
 again AS (SELECT r, pos FROM starts WHERE s IN (SELECT s FROM starts GROUP BY s HAVING count(*) > 1)),
 marked AS (SELECT r, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY r ORDER BY pos) + 200 THEN 0 ELSE 1 END fresh FROM again),
 runs AS (SELECT r, min(pos) a, max(pos) + 200 b FROM (SELECT r, pos, sum(fresh) OVER (PARTITION BY r ORDER BY pos) run FROM marked) GROUP BY r, run),
 spans AS (SELECT r, list(struct_pack(a := a, b := b) ORDER BY a) s FROM runs GROUP BY r),
 joined AS (SELECT d.r, doc_id, h, coalesce(s, []) s FROM d LEFT JOIN spans USING (r)),
 kept AS (SELECT r, doc_id, h, s, CASE WHEN len(s) = 0 THEN h ELSE array_to_string(list_transform(range(0, len(s) + 1), lambda i: substr(h, CASE WHEN i = 0 THEN 1 ELSE 2 * s[i].b + 1 END, CASE WHEN i = len(s) THEN length(h) ELSE 2 * s[i + 1].a END - CASE WHEN i = 0 THEN 0 ELSE 2 * s[i].b END)), '') END k FROM joined)
 SELECT doc_id, (length(h) // 2)::BIGINT n_bytes, ((length(h) - length(k)) // 2)::BIGINT n_removed, len(s)::BIGINT n_spans, sha256(unhex(k)) kept_sha256 FROM kept"""


def oracle_sql() -> dict[str, str]:
    """SQL that DuckDB can run, for the queries that it can express. It lacks the hashes, codecs, tokenizer and models of the
    others: those are tested against brute-force versions."""
    return {"op9_suffix_dedup": _SUFFIX, "op10_warc": _WARC}
