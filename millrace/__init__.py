"""millrace: building and analysing language-model evaluation runs on Spark."""

from millrace.functions.answers import add_labels, extract, normalize_answer, normalize_text, validate
from millrace.functions.metrics import finish_reason, generation_metrics, step_metrics
from millrace.functions.prompts import render
from millrace.operators.report import accuracy, report, running_accuracy, summary, total_accuracy
from millrace.operators.states import mean_states, prompt_last_states, state_tables, token_states
from millrace.operators.store import VersionedTable, keep_last
from millrace.operators.upsert import StateStore, csr_pointers, resume_index, stored, upsert
from millrace.operators.vectors import mean_vectors, sum_vectors
from millrace.plans.process import generate, isolated, process, prompts, require_states
from millrace.session import session
from millrace.sources.jsonl import load_samples, parse_samples, read_lines, write_jsonl
from millrace.sources.normalize import NORMALIZERS, prepare, register_dataset

__all__ = [
    "NORMALIZERS", "StateStore", "VersionedTable", "accuracy", "add_labels", "csr_pointers", "extract", "finish_reason", "generate", "generation_metrics", "isolated",
    "keep_last", "load_samples", "mean_states", "mean_vectors", "normalize_answer", "normalize_text", "parse_samples", "prepare", "process", "prompt_last_states",
    "prompts", "read_lines", "register_dataset", "render", "report", "require_states", "resume_index", "running_accuracy", "session", "state_tables", "step_metrics", "stored", "sum_vectors",
    "summary", "token_states", "total_accuracy", "upsert", "validate", "write_jsonl",
]
