"""Table schemas of the corpus store.  JSON text columns of the data model are real nested columns here."""

from pyspark.sql.types import StructType

TABLES = {
    "repositories": "id string, owner_id string, name string, source_type string, source_url string, status string, "
    "total_files bigint, processed_files bigint, total_chunks bigint, total_loc bigint, "
    "languages map<string,bigint>, error_message string, created_at timestamp, updated_at timestamp",
    "files": "id string, repository_id string, path string, language string, extension string, size bigint, loc int, "
    "hash string, num_classes bigint, num_functions bigint, imports array<struct<module:string,line:int>>, "
    "complexity_score double, importance_score double, importance_level string, summary string",
    "symbols": "repository_id string, file_id string, name string, type string, start_line int, end_line int, "
    "parent_name string, signature string, docstring string, complexity double",
    "code_chunks": "id string, file_id string, repository_id string, symbol_name string, symbol_type string, "
    "language string, file_path string, start_line int, end_line int, content string, chunk_index int",
    "vectors": "id string, repository_id string, file_path string, symbol_name string, symbol_type string, "
    "language string, start_line int, end_line int, document string, embedding array<float>",
    "analysis_issues": "repository_id string, file_id string, path string, issue_type string, severity string, "
    "message string, line int, suggestion string, run_id string",
    "repository_jobs": "id string, repository_id string, job_type string, status string, progress int, "
    "coverage struct<score_version:string,scanned_files:bigint,scanned_loc:bigint>, error_message string, "
    "created_at timestamp, updated_at timestamp",
    "repository_summaries": "id string, repository_id string, summary_type string, target_path string, "
    "content string, created_at timestamp, updated_at timestamp",
    "conversations": "id string, repository_id string, title string, created_at timestamp, updated_at timestamp",
    "messages": "id string, conversation_id string, role string, content string, "
    "sources array<struct<file_path:string,symbol_name:string,symbol_type:string,start_line:int,end_line:int,"
    "score:double>>, created_at timestamp",
    "analysis_admissions": "repository_id string, owner_id string, source_key string, revision string, "
    "status string, created_at timestamp",
    "account_usage": "owner_id string",
    "account_deletions": "owner_id string, repository_ids array<string>, phase string, created_at timestamp",
}
# the tables that an index run writes
INDEX_TABLES = {name: TABLES[name] for name in ("files", "symbols", "code_chunks", "vectors")}


def schema(name):
    return StructType.fromDDL(TABLES[name])
