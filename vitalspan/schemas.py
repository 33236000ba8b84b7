"""The tables of an index and of a corpus, as Spark schemas."""

from __future__ import annotations

STAT = "array<map<string,string>>"
INDEX = {
    "source_file": "path string, kind string, sha256 string, size_bytes long, ingested_at string, record_count long, status string",
    "characteristic": "key string, value string",
    "record": "type string, value_num double, value_text string, unit string, source_name string, source_version string, device string, start_date string, end_date string, creation_date string, start_epoch double, duration_sec double, local_date date, metadata map<string,string>, dedup_key binary, seq long",
    "workout": f"activity_type string, duration double, duration_unit string, total_distance double, total_distance_unit string, total_energy double, total_energy_unit string, source_name string, source_version string, device string, start_date string, end_date string, creation_date string, start_epoch double, local_date date, metadata map<string,string>, statistics {STAT}, indoor boolean, dedup_key binary, seq long, id long",
    "workout_stat": "workout_id long, kind string, key string, value_num double, value_text string, unit string",
    "activity_summary": "local_date string, active_energy double, active_energy_goal double, active_energy_unit string, move_time double, move_time_goal double, exercise_time double, exercise_time_goal double, stand_hours double, stand_hours_goal double",
    "daily_metric": "local_date date, type string, source_name string, unit string, category string, n long, sum_value double, avg_value double, min_value double, max_value double, duration_sec double",
    "document": "id long, path string, kind string, title string, doc_date string, ingested_at string, page_count int, extraction string, fhir_resource_type string, fhir_id string",
    "document_tag": "document_id long, tag string",
    "document_page": "document_id long, page_no int, text string, extraction string",
    "lab_result": "id long, document_id long, page_no int, analyte string, analyte_key string, panel string, value_num double, value_text string, unit string, ref_low double, ref_high double, ref_text string, flag string, collected_date string, raw_line string, extracted_by string, via_ocr boolean",
    "chunk": "id long, document_id long, chunk_index int, section string, text string, embedded_with string",
    "clinical_fact": "document_id long, kind string, name string, code string, code_system string, status string, onset_date string, detail_text string, category string, dedup_key binary",
    "clinical_vital": "document_id long, metric string, metric_key string, code string, code_system string, category string, value_num double, value_text string, unit string, measured_at string, local_date string",
}
VECTOR = "chunk_id long, document_id long, page_no int, embedder string, text string, vector array<float>"
INDEX["vector"] = VECTOR
CORPUS = {
    "pack": "pack string, title string, version string, installed_at string",
    "article": "pmid string, title string, abstract string, doi string, journal string, year int, publication_types array<string>, tier string, tier_rank int, tier_source string, retracted boolean, retraction_note string",
    "article_pack": "pmid string, pack string",
    "refresh_log": "id long, pack string, ran_at string, added long, retracted long",
    "mesh_term": "pmid string, term string, major boolean",
    "slice": "query string, first string, last string, hits long, fetched long, status string, error string",
    "article_chunk": "id long, pmid string, chunk_index int, text string, embedded_with string",
    "vector": VECTOR,
}
KEYWORDS = {
    "text": "id long, length int",
    "word": "term string, segment int, df long",
    "block": "term string, segment int, part int, place int, n long, most int, shortest int, entries array<struct<id:long,tf:int,length:int>>",
    "gone": "id long",
}
