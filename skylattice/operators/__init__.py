"""Operators over long tables keyed by query, probe, source and row.

Shared shapes: frames(row_id, video_id, n, frame_idx, ts_ms), probes(query_id, probe_idx, text),
scores(query_id, probe_idx, source, row_id, score, covered), fused(query_id, probe_idx, row_id, s).
`covered` says that a source has data for a row; a score of zero says that the data did not match.
"""
