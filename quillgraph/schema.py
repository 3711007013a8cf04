"""Schemas (as DDL) and fixed vocabularies of the code graph."""

from __future__ import annotations

NODE = "id string, name string, kind string, file_path string, start_line int, end_line int, snippet string, signature string, docstring string, metadata string, file_ord long, emit_ord int"
EDGE = "id string, source_id string, target_id string, target_name string, kind string, file_path string, line int, confidence string, metadata string, file_ord long, emit_ord int"
FILE = "path string, hash string, size long, mtime_ms double, language string, node_count int, edge_count int"
SNAPSHOT = "path string, size long, mtime_ms double, content string"
WORKSPACE = "id string, name string, root_path string, last_accessed long, total_nodes long, total_edges long, total_files long"

# Node kinds, edge kinds, risk levels in rising order.
NODE_KINDS = ["file", "function", "method", "class", "interface", "type", "variable", "route", "doc_section", "doc_document"]
EDGE_KINDS = ["contains", "imports", "calls", "extends", "implements", "references", "documents", "exports"]
RISKS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
#: Kinds that a change travels along, against their direction.
IMPACT_KINDS = ["calls", "imports", "references"]
CALL_KINDS = ["calls", "references"]
#: Prefixes of ids that point outside the graph.
EXTERNAL = ("sym:", "pkg:", "crate:", "file:")

# Language of each file extension.
LANGUAGES = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "python": "py pyw", "go": "go", "rust": "rs", "dart": "dart", "vue": "vue", "svelte": "svelte",
    "prisma": "prisma", "sql": "sql", "kotlin": "kt kts", "java": "java", "csharp": "cs", "cpp": "cpp cc cxx c h hpp", "ruby": "rb", "php": "php",
    "markdown": "md mdx markdown", "json": "json", "yaml": "yaml yml",
}
EXTENSIONS = {e: lang for lang, es in LANGUAGES.items() for e in es.split()}
#: Extensions that are scanned, though two of them have no language.
SCANNED = sorted({*EXTENSIONS, "astro", "swift"})
MAX_FILE_BYTES = 1 << 20

# Path segments and suffixes that are never scanned.
IGNORED_SEGMENTS = [
    "node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", ".output", ".turbo", ".svelte-kit", ".dart_tool", "coverage", ".cache", "__pycache__", "venv", ".venv", "vendor", "target",
    ".gradle", "obj", "bin", "KNOWLEDGE_BASE.md", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "composer.lock", "Cargo.lock", "Gemfile.lock", "poetry.lock",
    ".vscode", ".idea", ".claude-plugin", ".github", ".husky", ".quillgraph",
]
IGNORED_SUFFIXES = [".tmp", ".log", ".lock", ".min.js", ".min.css", ".bundle.js", ".map"]
# File names that hold secrets.
SECRET_NAMES = [r"^\.env(\..+)?$", r"\.pem$", r"\.key$", r"^id_(rsa|dsa|ecdsa|ed25519)$", r"\.p12$", r"\.pfx$", r"^credentials(\..+)?$", r"^secrets?\.(json|ya?ml|toml)$"]
