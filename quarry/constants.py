"""Fixed values that must equal the behaviour being reproduced.

Everything below is a fixed value (lists, maps, templates, limits) stated plainly and
in natural order. Code elsewhere reads them from here; nothing is derived.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: file scan
# ---------------------------------------------------------------------------
DENY_DIRS = [
    "__pycache__",
    ".pytest_cache",
    ".venv",
    ".git",
    ".idea",
    "venv",
    "env",
    "node_modules",
    "dist",
    "build",
    ".vscode",
    ".github",
    ".gitlab",
    ".angular",
    "cdk.out",
    ".aws-sam",
    ".terraform",
]
ALLOWED_EXTENSIONS = [".java", ".py", ".js", ".rs"]
DENY_FILES = ["docker-compose.yml"]
EXTENSION_LANGUAGE = {
    ".java": "java",
    ".py": "python",
    ".js": "javascript",
    ".rs": "rust",
}
SPECIAL_SUFFIXES = [".md", ".sh"]

# ---------------------------------------------------------------------------
# FIXED VALUES: limits
# ---------------------------------------------------------------------------
TOP_K = 5
KEEP_TOP = 3
CONTEXT_CHARS = 12000
MAX_TOKENS_SMALL = 4000
MAX_TOKENS_LARGE = 8000
HISTORY_LAST = 5
ENRICH_BATCH = 32
ENRICH_CONCURRENCY = 16
PREVIEW_CHARS = 200

# ---------------------------------------------------------------------------
# FIXED VALUES: text formats
# ---------------------------------------------------------------------------
METHOD_DECL_SEPARATOR = "\n-----\n"
REFERENCE_SEPARATOR = "; "
CONTEXT_DIRECTIVE = "@codebase"
NULL_FILL_METHOD = "empty"
NULL_FILL_CLASS = ""
PLACEHOLDER = "empty"
CONTEXT_BRIDGE = "\n below is class or constructor related code \n"
# Class row text: "File: {p}\n\nClass: {c}\n\nSource Code:\n{clipped}\n\n"
# Special file text: "File: {p}\n\nContent:\n{clipped}\n\n"
# Method context item: "File: {file_path}\nCode:\n{code}", joined by "\n\n"
# Class context item: "File: {p}\nClass Info:\n{src} References: \n{refs}  \n END OF ROW {i}", joined by "\n\n"
# Enrichment prompt: "Class: {class_name}\nMethod: {name}\nSource Code:\n{source_code}"
HYDE_USER_PREFIX = "Help predict the answer to the query: "
HYDE_V2_USER_PREFIX = "Predict the answer to the query: "

# ---------------------------------------------------------------------------
# FIXED VALUES: prompt templates
# ---------------------------------------------------------------------------
HYDE_SYSTEM_PROMPT = '''You are an expert software engineer. Your task is to predict code that answers the given query.

Instructions:
1. Analyze the query carefully.
2. Think through the solution step-by-step.
3. Generate concise, idiomatic code that addresses the query.
4. Include specific method names, class names, and key concepts in your response.
5. If applicable, suggest modern libraries or best practices for the given task.
6. You may guess the language based on the context provided.

Output format: 
- Provide only the improved query or predicted code snippet.
- Do not include any explanatory text outside the code.
- Ensure the response is directly usable for further processing or execution.'''

HYDE_V2_SYSTEM_PROMPT = '''You are an expert software engineer. Your task is to enhance the original query: {query} using the provided context: {temp_context}.

Instructions:
1. Analyze the query and context thoroughly.
2. Expand the query with relevant code-specific details:
   - For code-related queries: Include precise method names, class names, and key concepts.
   - For general queries: Reference important files like README.md or configuration files.
   - For method-specific queries: Predict potential implementation details and suggest modern, relevant libraries.
3. Incorporate keywords from the context that are most pertinent to answering the query.
4. Add any crucial terminology or best practices that might be relevant.
5. Ensure the enhanced query remains focused and concise while being more descriptive and targeted.
6. You may guess the language based on the context provided.

Output format: Provide only the enhanced query. Do not include any explanatory text or additional commentary.'''

REFERENCES_SYSTEM_PROMPT = '''You are an expert software engineer. Given the <query>{query}</query> and <context>{context}</context>, your task is to enhance the query:

1. Analyze the query and context thoroughly.
2. Frame a concise, improved query using keywords from the context that are most relevant to answering the original query.
3. Include specific code-related details such as method names, class names, and key programming concepts.
4. If applicable, reference important files like README.md or configuration files.
5. Add any crucial programming terminology or best practices that might be relevant.
6. Ensure the enhanced query remains focused while being more descriptive and targeted.

Output format:
<query>Enhanced query here</query>

Provide only the enhanced query within the tags. Do not include any explanatory text or additional commentary.'''

CHAT_SYSTEM_PROMPT = '''You are an expert software engineer providing codebase assistance. Using the provided <context>{context}</context>:

CORE RESPONSIBILITIES:
1. Answer technical questions about the codebase
2. Explain code architecture and design patterns
3. Debug issues and suggest improvements
4. Provide implementation guidance

RESPONSE GUIDELINES:

Most importantly - If you are not sure about the answer, say so. Ask user politely for more context and tell them to use "@codebase" to provide more context.

1. Code References:
   - Use `inline code` for methods, variables, and short snippets
   - Use ```language blocks for multi-line code examples
   - Specify file paths when referencing code locations if confident

2. Explanations:
   - Break down complex concepts step-by-step
   - Connect explanations to specific code examples
   - Include relevant design decisions and trade-offs

3. Best Practices:
   - Suggest improvements when applicable
   - Reference industry standards or patterns
   - Explain the reasoning behind recommendations

4. Technical Depth:
   - Scale detail based on query complexity
   - Link to references when available
   - Acknowledge limitations if context is insufficient

If you need additional context or clarification, request it specifically.'''

ENRICH_SYSTEM_PROMPT = """You are an expert programmer who specializes in java, python, rust and javascript. Describe the code in less than 3 lines. Do not add fluff like "the code you provided"."""

# --- column names of the entity tables (fixed values) ------------------------------
CLASS_FIELDS = ["file_path", "class_name", "constructor_declaration", "method_declarations", "source_code", "references"]
METHOD_FIELDS = ["file_path", "class_name", "name", "doc_comment", "source_code", "references"]
CLASS_COLUMNS = ["source_code", "file_path", "class_name", "constructor_declaration", "method_declarations", "references"]
METHOD_COLUMNS = ["code", "file_path", "class_name", "name", "doc_comment", "source_code", "references"]
