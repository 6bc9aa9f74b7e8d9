"""Language registry: extensions, and the line-level grammar used to find symbols."""

from __future__ import annotations

from dataclasses import dataclass, field

# Language id -> (label, extensions).
CODE_LANGUAGES = {
    "typescript": ("TypeScript", [".ts", ".mts", ".cts"]),
    "tsx": ("TSX", [".tsx"]),
    "javascript": ("JavaScript", [".js", ".mjs", ".cjs", ".jsx"]),
    "python": ("Python", [".py", ".pyi"]),
    "java": ("Java", [".java"]),
    "kotlin": ("Kotlin", [".kt", ".kts"]),
    "go": ("Go", [".go"]),
    "rust": ("Rust", [".rs"]),
    "csharp": ("C#", [".cs"]),
    "php": ("PHP", [".php"]),
    "ruby": ("Ruby", [".rb"]),
    "c": ("C", [".c", ".h"]),
    "cpp": ("C++", [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"]),
    "swift": ("Swift", [".swift"]),
    "dart": ("Dart", [".dart"]),
    "scala": ("Scala", [".scala", ".sc"]),
    "ruby_erb": ("ERB", [".erb"]),
    "lua": ("Lua", [".lua"]),
    "elixir": ("Elixir", [".ex", ".exs"]),
    "solidity": ("Solidity", [".sol"]),
    "bash": ("Shell", [".sh", ".bash"]),
}
# Data and markup formats, recorded but not mined for symbols.
DATA_LANGUAGES = {
    "json": ("JSON", [".json"]),
    "yaml": ("YAML", [".yaml", ".yml"]),
    "toml": ("TOML", [".toml"]),
    "html": ("HTML", [".html", ".htm"]),
    "css": ("CSS", [".css", ".scss", ".sass", ".less"]),
    "vue": ("Vue", [".vue"]),
}
EXT_TO_LANG = {e: lang for reg in (CODE_LANGUAGES, DATA_LANGUAGES) for lang, (_, exts) in reg.items() for e in exts}
LABELS = {lang: label for reg in (CODE_LANGUAGES, DATA_LANGUAGES) for lang, (label, _) in reg.items()}

# Languages with value tracing, and those with symbols only.
DEEP_LANGUAGES = ["java", "typescript", "tsx", "javascript"]
# File names with a known role.
META_FILES = {
    "package.json": "npm", "package-lock.json": "npm-lock", "yarn.lock": "yarn-lock", "pnpm-lock.yaml": "pnpm-lock",
    "tsconfig.json": "tsconfig", "requirements.txt": "pip", "pyproject.toml": "python-project", "setup.py": "python-setup",
    "Pipfile": "pipenv", "go.mod": "gomod", "go.sum": "gosum", "Cargo.toml": "cargo", "Cargo.lock": "cargo-lock",
    "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "composer.json": "composer",
    "Gemfile": "bundler", "Gemfile.lock": "bundler-lock", "pubspec.yaml": "dart-pub", "build.sbt": "sbt",
    "docker-compose.yml": "compose", "docker-compose.yaml": "compose", "Makefile": "make", "CMakeLists.txt": "cmake",
}
META_PATTERNS = [(r"\.csproj$", "dotnet"), (r"^\.env", "env"), (r"^Dockerfile", "docker")]


@dataclass(frozen=True)
class Grammar:
    """Regexes over masked code (comments and string bodies blanked). Group 1 is the name."""

    style: str  # how blocks end: brace, indent or end
    functions: list[str]
    classes: list[tuple[str, str]] = field(default_factory=list)  # (kind, regex)
    imports: list[str] = field(default_factory=list)  # over raw text; the source is cut out later
    branch: str = r"\b(?:if|for|while|do|catch|else|case)\b|&&|\|\|"


_L = r"(?m)^[ \t]*"
_JVM_MOD = r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|protected|internal|static|final|abstract|synchronized|override|virtual|async|sealed|partial|default)\s+)*"
_NOT_STMT = r"(?!return\b|new\b|else\b|throw\b|if\b|for\b|while\b|switch\b|catch\b|await\b|using\b|package\b|import\b)"
_TYPED_FN = (
    _L + _JVM_MOD + _NOT_STMT + r"(?:<[^>\n]+>\s*)?[A-Za-z_][\w.<>\[\],? ]*[\w>\]]\s+(?!if\b|for\b|while\b|switch\b|catch\b)(\w+)\s*\([^;{}()]*+(?:\([^()]*+\)[^;{}()]*+)*+\)\s*(?:throws\s+[\w., ]+)?\s*[{;]"
)
_CTOR = _L + r"(?:@\w+(?:\([^)]*\))?\s+)*(?:public|private|protected)\s+(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w., ]+)?\s*\{"
_JS_FN = _L + r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"
_JS_ARROW = _L + r"(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n]+)?=>|\w+\s*=>)"
_JS_METHOD = (
    r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?"
    r"(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b|with\b)(\w+)\s*\([^(){};]*+(?:\([^()]*+\)[^(){};]*+)*+\)\s*(?::\s*[^{;=\n]+)?\{"
)
_JS_IMPORT = [r"(?m)^[ \t]*import\b[^;'\"`]*['\"][^'\"]+['\"]", r"\brequire\(\s*['\"][^'\"]+['\"]\s*\)"]
_JS_BRANCH = r"\b(?:if|for|while|do|catch|else)\b|&&|\|\||\?\?|\s\?\s"
#: The first function without a name on a line, unless the line gives it one; what follows the hit is its body.
ANONYMOUS = (
    r"(?m)^(?![ \t]*(?:export\s+)?(?:const|let|var)\s+\w+\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()\n]*\)\s*(?::[^=\n]+)?=>|\w+\s*=>))"
    r"[^\n]*?(?:\([^()\n]*\)[ \t]*(?::[^=\n]+)?=>|(?<![\w$.])[A-Za-z_$][\w$]*[ \t]*=>|(?<![\w$.])function[ \t]*\*?[ \t]*\([^()\n]*\))"
)
_JS = [_JS_FN, _JS_ARROW, _JS_METHOD, ANONYMOUS]
_TS_CLASSES = [
    ("class", _L + r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("interface", _L + r"(?:export\s+)?interface\s+(\w+)"),
    ("enum", _L + r"(?:export\s+)?(?:const\s+)?enum\s+(\w+)"),
    ("type_alias", _L + r"(?:export\s+)?type\s+(\w+)\s*(?:<[^=]*>)?\s*="),
]
_JVM_CLASSES = [(k, _L + _JVM_MOD + k + r"\s+(\w+)") for k in ("class", "interface", "enum", "record")]
_C_FN = r"(?m)^(?!else\b|return\b|typedef\b)[A-Za-z_][\w\s*&:<>,]*?[\s*&]~?(?:\w+::)*(\w+)\s*\([^;{}()]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{"

# The grammar of every language.
GRAMMARS = {
    "typescript": Grammar("brace", _JS, _TS_CLASSES, _JS_IMPORT, _JS_BRANCH),
    "tsx": Grammar("brace", _JS, _TS_CLASSES, _JS_IMPORT, _JS_BRANCH),
    "javascript": Grammar("brace", _JS, _TS_CLASSES[:1], _JS_IMPORT, _JS_BRANCH),
    "python": Grammar(
        "indent", [_L + r"(?:async\s+)?def\s+(\w+)\s*\("], [("class", _L + r"class\s+(\w+)")],
        [_L + r"import\s+[\w.]+[^\n]*", _L + r"from\s+[\w.]+\s+import\s+[^\n]+"],
        r"(?m)^[ \t]*(?:async\s+)?(?:if|elif|else|for|while)\b|\b(?:and|or)\b|(?<=\S)\sif\s",
    ),
    "java": Grammar(
        "brace", [_TYPED_FN, _CTOR], _JVM_CLASSES, [_L + r"import\s+(?:static\s+)?[\w.*]+\s*;"],
        r"\b(?:if|while|do|catch)\b|\bfor\s*\([^:;]*;|&&|\|\||\s\?\s",
    ),
    "kotlin": Grammar(
        "brace", [_L + r"(?:[\w@]+\s+)*fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?(\w+)\s*\("],
        [("class", _L + r"(?:[\w@]+\s+)*(?:class|interface)\s+(\w+)"), ("object", _L + r"(?:\w+\s+)*object\s+(\w+)")],
        [_L + r"import\s+[\w.*]+"], r"\b(?:if|for|while|do|catch|when)\b|&&|\|\|",
    ),
    "go": Grammar(
        "brace", [r"(?m)^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[(\[]"], [("type", _L + r"type\s+(\w+)\s+(?:struct|interface)\b")],
        [r"(?m)^[ \t]*(?:import\s+)?(?:\w+\s+)?\"[\w./\-]+\"[ \t]*$"], r"\b(?:if|for)\b|&&|\|\|",
    ),
    "rust": Grammar(
        "brace", [_L + r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)"],
        [(k, _L + rf"(?:pub(?:\([^)]*\))?\s+)?{k}(?:<[^>]*>)?\s+(\w+)") for k in ("struct", "enum", "trait", "impl")],
        [_L + r"(?:pub\s+)?use\s+[^;]+;"], r"\b(?:if|for|while|else)\b|=>|&&|\|\|",
    ),
    "csharp": Grammar(
        "brace", [_TYPED_FN, _CTOR], [(k, _L + _JVM_MOD + k + r"\s+(\w+)") for k in ("class", "interface", "struct", "enum", "record")],
        [_L + r"using\s+[\w.]+\s*;"], r"\b(?:if|for|while|do|catch|else)\b|&&|\|\||\?\?|\s\?\s",
    ),
    "php": Grammar(
        "brace", [_L + r"(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?(\w+)\s*\("],
        [(k, _L + rf"(?:(?:abstract|final)\s+)?{k}\s+(\w+)") for k in ("class", "interface", "trait", "enum")],
        [_L + r"use\s+[\w\\]+[^;]*;"], r"\b(?:if|for|while|do|catch|else|case)\b|&&|\|\||\?\?|\s\?\s",
    ),
    "ruby": Grammar(
        "end", [_L + r"def\s+(?:self\.)?(\w+[?!=]?)"], [("class", _L + r"class\s+([A-Z]\w*)"), ("module", _L + r"module\s+([A-Z]\w*)")],
        [_L + r"(?:require|require_relative|load)\s*\(?\s*['\"][^'\"]+['\"]"], r"\b(?:when|rescue|case)\b|&&|\|\||\b(?:and|or)\b",
    ),
    "c": Grammar(
        "brace", [_C_FN], [(k, _L + rf"(?:typedef\s+)?{k}\s+(\w+)\s*\{{") for k in ("struct", "enum", "union")],
        [_L + r"#include\s*[<\"][^>\"\n]+[>\"]"], r"\b(?:if|for|while|do|else)\b|&&|\|\||\s\?\s",
    ),
    "cpp": Grammar(
        "brace", [_C_FN], [(k, _L + rf"{k}\s+(\w+)[^;{{]*\{{") for k in ("class", "struct", "enum")],
        [_L + r"#include\s*[<\"][^>\"\n]+[>\"]"], r"\b(?:if|for|while|do|catch|else)\b|&&|\|\||\s\?\s",
    ),
    "swift": Grammar(
        "brace", [_L + r"(?:[\w@]+\s+)*func\s+(\w+)"], [("class", _L + r"(?:\w+\s+)*class\s+(\w+)"), ("protocol", _L + r"(?:\w+\s+)*protocol\s+(\w+)")],
        [_L + r"import\s+\w+"], r"\b(?:if|for|while|guard|catch|else)\b|&&|\|\||\?\?",
    ),
    "dart": Grammar("brace", [_TYPED_FN], [("class", _L + r"(?:abstract\s+)?class\s+(\w+)"), ("enum", _L + r"enum\s+(\w+)")], [_L + r"(?:import|export)\s+['\"][^'\"]+['\"]"]),
    "scala": Grammar(
        "brace", [_L + r"(?:[\w@]+\s+)*def\s+(\w+)"], [(k, _L + rf"(?:\w+\s+)*{k}\s+(\w+)") for k in ("class", "object", "trait")],
        [_L + r"import\s+[^\n]+"],
    ),
    "lua": Grammar("end", [_L + r"(?:local\s+)?function\s+(?:\w+[.:])*(\w+)\s*\("], [], [r"\brequire\s*\(?\s*['\"][^'\"]+['\"]"], r"\b(?:if|for|while|elseif|else)\b|\b(?:and|or)\b"),
    "elixir": Grammar("end", [_L + r"defp?\s+(\w+[?!]?)"], [("call", _L + r"defmodule\s+([\w.]+)")], [_L + r"(?:import|alias|use|require)\s+[\w.]+"], r"&&|\|\||\b(?:and|or)\b"),
    "solidity": Grammar(
        "brace", [_L + r"function\s+(\w+)"], [(k, _L + rf"(?:abstract\s+)?{k}\s+(\w+)") for k in ("contract", "interface", "library")],
        [_L + r"import\s+[^;]+;"],
    ),
    "bash": Grammar("brace", [_L + r"(?:function\s+)?(\w+)\s*\(\)\s*\{"], [], [], r"\b(?:if|for|while|elif|else)\b|&&|\|\|"),
}
COMMENT_LINE = r"^\s*(//|#|\*|/\*)"
CALL = r"(?<![\w$])(?<!\bnew\s)([A-Za-z_$][\w$]*)\s*\("
# Words that look like a call but are not.
NOT_CALLS = "if for while switch catch return function and or not in elif with lambda def class super await typeof sizeof assert using fn func match".split()
