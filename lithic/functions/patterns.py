"""Signal patterns. Every list in this module holds fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Pattern:
    label: str
    regex: str
    groups: dict[str, int] = field(default_factory=dict)
    severity: str = ""
    category: str = ""
    needs: str = ""


# HTTP routes. Groups name the captured method and path.
ROUTES = [
    Pattern("express", r"(?i)\b(?:app|router|route|api|server|fastify)\.(get|post|put|patch|delete|options|head|all)\s*\(\s*[`'\"]([^`'\"]+)[`'\"]", {"method": 1, "path": 2}),
    Pattern("python-web", r"(?i)@(?:app|router|blueprint|bp)\.(get|post|put|patch|delete|route)\s*\(\s*[`'\"]([^`'\"]+)[`'\"]", {"method": 1, "path": 2}),
    Pattern("spring", r"@(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(\s*(?:value\s*=\s*)?[`'\"]([^`'\"]+)[`'\"]", {"method": 1, "path": 2}),
    Pattern("go-http", r"\.(HandleFunc|Handle|Get|Post|Put|Patch|Delete)\s*\(\s*[`'\"]([^`'\"]+)[`'\"]", {"method": 1, "path": 2}),
    Pattern("rails", r"(?im)^\s*(get|post|put|patch|delete)\s+[`'\"]([^`'\"]+)[`'\"]", {"method": 1, "path": 2}),
    Pattern("laravel", r"Route::(get|post|put|patch|delete|any|match)\s*\(\s*[`'\"]([^`'\"]+)[`'\"]", {"method": 1, "path": 2}),
    Pattern("aspnet", r"\[Http(Get|Post|Put|Patch|Delete)\s*\(\s*[`'\"]([^`'\"]+)[`'\"]", {"method": 1, "path": 2}),
    Pattern("django", r"\b(?:path|re_path|url)\s*\(\s*[`'\"]([^`'\"]*)[`'\"]\s*,", {"path": 1}),
]
EXPORTED_VERB = r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"

# Database access through mappers; `needs` must occur somewhere in the file.
DB = [
    Pattern("supabase/query", r"\.from\s*\(\s*[`'\"]([a-zA-Z_][\w.]*)[`'\"]\s*\)", {"table": 1}, needs=r"supabase|createClient|\.select\(|\.insert\(|\.upsert\("),
    Pattern("prisma", r"\bprisma\.([a-zA-Z_]\w*)\.(findMany|findFirst|findUnique|create|createMany|update|updateMany|delete|deleteMany|upsert|count|aggregate)", {"table": 1, "op": 2}),
    Pattern("drizzle", r"\bdb\.(?:select|insert|update|delete)\([\s\S]{0,40}?\.from\(\s*([a-zA-Z_]\w*)", {"table": 1}),
    Pattern("django-orm", r"\b([A-Z]\w*)\.objects\.(all|filter|get|create|update|delete|exclude|values)\b", {"table": 1, "op": 2}, needs=r"models|django"),
    Pattern("mongoose", r"\bawait\s+([A-Z]\w*)\.(find|findOne|findById|findByIdAndUpdate|updateOne|updateMany|deleteOne|deleteMany|aggregate)\s*\(", {"table": 1, "op": 2}, needs=r"mongoose|Schema|model\("),
]
SQL_DDL = Pattern("ddl-table", r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`']?([a-zA-Z_][\w.]*)[\"`']?\s*\(", {"table": 1})
SQL_DML = Pattern("sql", r"(?i)\b(?:from|into|update|join)\s+[\"`']?([a-zA-Z_][\w.]*)", {"table": 1})
SQL_IN_STRING = Pattern("sql", r"(?i)[`'\"]\s*(?:SELECT\s+[\s\S]{0,200}?\bFROM|INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+[\"`']?([a-zA-Z_][\w.]*)", {"table": 1}, needs=r"(?i)select|insert|update|delete")
DB_STOP = r"(?i)^(the|a|an|select|where|await|if|for|this|self|result|res|data|item|value|Object|Array|Promise|Math|JSON|String|Number|Boolean|Error)$"
DML_STOP = r"(?i)^(select|where|the|dual)$"
SQL_STRING_STOP = r"(?i)^(select|where|dual)$"

# Environment variables, first capture is the name.
ENV = [
    r"process\.env\.([A-Z_][A-Z0-9_]*)",
    r"process\.env\[[`'\"]([A-Z_][A-Z0-9_]*)[`'\"]\]",
    r"os\.environ(?:\.get)?\[?[`'\"(]\s*[`'\"]?([A-Z_][A-Z0-9_]*)",
    r"os\.getenv\(\s*[`'\"]([A-Z_][A-Z0-9_]*)",
    r"System\.getenv\(\s*[`'\"]([A-Z_][A-Z0-9_]*)",
    r"ENV\[[`'\"]([A-Z_][A-Z0-9_]*)[`'\"]\]",
    r"os\.Getenv\(\s*[`'\"]([A-Z_][A-Z0-9_]*)",
    r"std::env::var\(\s*[`'\"]([A-Z_][A-Z0-9_]*)",
    r"getenv\(\s*[`'\"]([A-Z_][A-Z0-9_]*)",
]

# Secrets.
SECRETS = [
    Pattern("AWS access key id", r"\bAKIA[0-9A-Z]{16}\b", severity="high"),
    Pattern("AWS temp key id", r"\bASIA[0-9A-Z]{16}\b", severity="high"),
    Pattern("GitHub token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", severity="high"),
    Pattern("Slack token", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", severity="high"),
    Pattern("Private key", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----", severity="high"),
    Pattern("OpenAI-style secret key", r"\bsk-[A-Za-z0-9]{20,}\b", severity="high"),
    Pattern("Google API key", r"\bAIza[0-9A-Za-z_\-]{35}\b", severity="medium"),
    Pattern("JWT (hardcoded)", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b", severity="medium"),
    Pattern("Hardcoded credential", r"(?i)(?:password|passwd|pwd|secret|api[_-]?key|token|access[_-]?key)\s*[:=]\s*[`'\"][^`'\"\s]{8,}[`'\"]", severity="medium"),
]
# Dangerous calls.
DANGEROUS = [
    Pattern("eval() use", r"\beval\s*\(", severity="medium", category="code-exec"),
    Pattern("shell/command execution", r"\bexec\s*\(|child_process|subprocess\.(call|run|Popen)|os\.system\(", severity="medium", category="command-exec"),
    Pattern("Potential XSS sink", r"dangerouslySetInnerHTML|\.innerHTML\s*=|v-html|document\.write\(", severity="medium", category="xss"),
    Pattern("Possible SQL string interpolation (injection)", r"(?:query|execute)\s*\(\s*[`'\"][^`'\"]*(?:\$\{|\+\s*\w+|%s|%d)", severity="medium", category="sql-injection"),
    Pattern("TLS verification disabled", r"verify\s*:\s*false|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true|verify=False", severity="high", category="tls"),
    Pattern("Weak hash (MD5/SHA1)", r"(?i)md5\(|sha1\(|hashlib\.md5|MessageDigest\.getInstance\(\s*[`'\"]MD5", severity="low", category="crypto"),
]
EXAMPLE_FILE = r"\.example$|\.sample$|\.template$"

# Background jobs.
JOBS = [
    Pattern("cron", r"cron\.schedule\s*\(\s*[`'\"]([^`'\"]+)", {"detail": 1}),
    Pattern("scheduled", r"@(Scheduled|Cron)\s*\("),
    Pattern("queue-worker", r"new\s+(Worker|Queue|Bull|Bee)\s*\(\s*[`'\"]?([\w-]*)", {"detail": 2}),
    Pattern("celery-task", r"celery\.task|@(?:app\.)?task\b|@shared_task"),
    Pattern("job", r"(?i)@(?:repeatable_)?(?:job|task)\b|sidekiq|ActiveJob"),
    Pattern("timer", r"setInterval\s*\(|setTimeout\s*\([^,]+,\s*\d{4,}"),
    Pattern("schedule", r"schedule\s*\.\s*every\s*\("),
]

# Infrastructure files, first match wins: (regex on path, regex on base name, type, system).
INFRA = [
    (r"\.github/workflows/.*\.ya?ml$", None, "ci", "github-actions"),
    (None, r"^\.gitlab-ci\.yml$", "ci", "gitlab-ci"),
    (r"\.circleci/config\.yml$", None, "ci", "circleci"),
    (None, r"^\.travis\.yml$", "ci", "travis"),
    (None, r"azure-pipelines\.ya?ml$", "ci", "azure-pipelines"),
    (None, r"^Jenkinsfile$", "ci", "jenkins"),
    (None, r"^Dockerfile$|^Dockerfile\.", "container", "docker"),
    (None, r"docker-compose\.ya?ml$", "container", "docker-compose"),
    (None, r"^Makefile$", "build", "make"),
    (None, r"\.tf$", "iac", "terraform"),
    (None, r"^vercel\.json$", "deploy", "vercel"),
    (None, r"^netlify\.toml$", "deploy", "netlify"),
    (None, r"^serverless\.yml$", "deploy", "serverless"),
    (r"\.k8s\.ya?ml$|kubernetes|deployment\.ya?ml$", None, "container", "kubernetes"),
]

# Architectural layer of a lower-cased path, first match wins.
LAYERS = [
    ("test", r"(^|/)(test|tests|spec|__tests__|__test__)(/|$)|\.(test|spec)\."),
    ("api", r"(^|/)(controller|controllers|routes|route|api|handler|handlers|endpoints)(/|\.)"),
    ("service", r"(^|/)(service|services|usecase|usecases|domain|business|logic)(/|\.)"),
    ("data", r"(^|/)(model|models|entity|entities|schema|schemas|repository|repositories|dao|dto|orm)(/|\.)"),
    ("ui", r"(^|/)(component|components|view|views|pages|page|ui|widgets|screens)(/|\.)"),
    ("lib", r"(^|/)(util|utils|helper|helpers|lib|libs|common|shared|core)(/|\.)"),
    ("config", r"(^|/)(config|configs|settings|env)(/|\.)"),
    ("config", r"\.(json|ya?ml|toml|xml|ini|env)$|dockerfile|makefile"),
]
# The four notions of a test path and the two of an entry point.
TEST_PATH = r"(^|/)(test|tests|spec|__tests__)(/|$)|\.(test|spec)\."
CAPABILITY_TEST_PATH = r"(^|/)(tests?|specs?|__tests__|e2e|fixtures?|examples?|mocks?|benchmarks?)(/|$)|\.(test|spec)\.|_test\.|test_"
PRODUCT_TEST_PATH = r"(^|/)(tests?|specs?|__tests__|e2e|fixtures?|mocks?)(/|$)|\.(test|spec)\.|_test\.|test_"
DOC_PATH = r"\.(md|mdx|rst|txt|adoc)$|(^|/)(docs?|documentation)(/|$)"
METRIC_ENTRYPOINT = (
    r"(^|/)(main|index|app|server|cli|__main__|program|mod)\.[a-z]+$|(^|/)(route|page|layout|middleware)\.[a-z]+$"
    r"|\.(test|spec)\.[a-z]+$|(^|/)(test|tests|spec|examples?|scripts?|bin|cmd)(/|$)|migrations?/|(^|/)setup\.py$|(^|/)conftest\.py$|\.d\.ts$"
)
CORE_ENTRYPOINT = r"(^|/)(main|index|app|server|cli|__main__|program|mod|manage)\.[a-z]+$|(^|/)(route|page|layout|middleware)\.[a-z]+$"
# What counts as a write, with and without schema definition.
WRITE_WITH_DDL = r"write|insert|update|delete|create|save|upsert|ddl"
WRITE_WITHOUT_DDL = r"write|insert|update|delete|create|save|upsert"
