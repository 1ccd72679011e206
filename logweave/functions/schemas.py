"""Normalised schemas: messages, sessions, usage, index."""

from __future__ import annotations

BLOCK = "struct<type:string,text:string,id:string,name:string,input_json:string,tool_use_id:string,content:string,is_error:boolean>"
BLOCKS = f"array<{BLOCK}>"
MESSAGES = f"source string, session_id string, file_path string, idx int, role string, ts timestamp, content string, blocks {BLOCKS}, raw_line_index int"
SESSIONS = "source string, session_id string, file_path string, cwd string, git_branch string, git_repo string, model string, created_at timestamp, updated_at timestamp, file_bytes bigint, raw_line_count bigint"
USAGE = "source string, session_id string, line_no int, input bigint, output bigint, cache_read bigint, cache_creation bigint"
INDEX = "id string, source string, cwd string, updated_at timestamp, summary string, file_path string"

ROLES = ("user", "assistant", "system", "tool_use", "tool_result")
KEY = ("source", "session_id")
