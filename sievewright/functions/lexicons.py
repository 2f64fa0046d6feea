"""Small general word lists for names."""

from __future__ import annotations

# Technologies and their written forms (matched by case, as whole words).
TECHNOLOGIES = {
    "PostgreSQL": ["PostgreSQL", "Postgres", "postgres", "Postgres 16", "PostgreSQL 16"],
    "pgvector": ["pgvector"],
    "Apache Kafka": ["Apache Kafka", "Kafka"],
    "Kubernetes": ["Kubernetes", "k8s", "K8s"],
    "Docker": ["Docker"],
    "Terraform": ["Terraform"],
    "Rust": ["Rust"],
    "Python": ["Python"],
    "Go": ["Golang"],
    "TypeScript": ["TypeScript"],
    "React": ["React"],
    "FastAPI": ["FastAPI"],
    "PyTorch": ["PyTorch", "Torch"],
    "TensorFlow": ["TensorFlow"],
    "ONNX Runtime": ["ONNX Runtime", "onnxruntime", "ORT"],
    "ONNX": ["ONNX"],
    "llama.cpp": ["llama.cpp"],
    "Ollama": ["Ollama"],
    "Redis": ["Redis"],
    "DuckDB": ["DuckDB"],
    "Elasticsearch": ["Elasticsearch", "Elastic", "ES cluster"],
    "OpenSearch": ["OpenSearch"],
    "Apache Airflow": ["Apache Airflow", "Airflow"],
    "Apache Spark": ["Apache Spark", "Spark"],
    "dbt": ["dbt"],
    "Snowflake": ["Snowflake"],
    "BigQuery": ["BigQuery"],
    "Amazon S3": ["Amazon S3", "S3"],
    "AWS": ["AWS", "Amazon Web Services"],
    "GCP": ["GCP", "Google Cloud"],
    "gRPC": ["gRPC"],
    "GraphQL": ["GraphQL"],
    "Grafana": ["Grafana"],
    "Prometheus": ["Prometheus"],
    "OpenTelemetry": ["OpenTelemetry", "OTel"],
    "OR-Tools": ["OR-Tools", "Google OR-Tools"],
    "spaCy": ["spaCy"],
    "sentence-transformers": ["sentence-transformers", "SentenceTransformers"],
    "MiniLM": ["MiniLM", "all-MiniLM-L6-v2"],
    "HNSW": ["HNSW"],
    "BM25": ["BM25"],
    "CUDA": ["CUDA"],
    "TensorRT": ["TensorRT"],
    "Core ML": ["Core ML", "CoreML"],
    "WebAssembly": ["WebAssembly", "WASM"],
    "SQLite": ["SQLite"],
    "MongoDB": ["MongoDB", "Mongo"],
    "ClickHouse": ["ClickHouse"],
    "Flink": ["Apache Flink", "Flink"],
    "Temporal": ["Temporal.io"],
    "Splink": ["Splink"],
    "HL7 FHIR": ["HL7 FHIR", "FHIR"],
    "AES-256": ["AES-256"],
    "Android": ["Android"],
    "iOS": ["iOS"],
    "Apache Parquet": ["Apache Parquet", "Parquet"],
    "Vault": ["HashiCorp Vault"],
}
ALIAS_OF = {form.lower(): name for name, forms in TECHNOLOGIES.items() for form in forms}

# Endings of company names, words that end an organization's name, titles, project words.
ORG_SUFFIXES = frozenset("inc incorporated corp corporation llc ltd limited co company plc gmbh sa ag bv pte".split())
ORG_HEADS = (
    "Inc Inc. Labs Lab Corp Corp. Corporation LLC Ltd Ltd. Logistics Health Systems Analytics Technologies University "
    "Capital Data AI Robotics Bank Group Partners Foundation Institute Hospital Networks Software Ventures"
).split()
PERSON_TITLES = frozenset("dr mr mrs ms prof professor sir".split())
PROJECT_WORDS = frozenset("project initiative program programme pilot".split())

# Large cities.
CITIES = (
    "New York", "San Francisco", "Seattle", "Austin", "Boston", "Chicago", "Toronto", "Montreal", "Vancouver", "London",
    "Paris", "Berlin", "Munich", "Amsterdam", "Lisbon", "Madrid", "Barcelona", "Dublin", "Zurich", "Stockholm", "Warsaw",
    "Singapore", "Tokyo", "Seoul", "Bangalore", "Bengaluru", "Mumbai", "Sydney", "Melbourne", "Lagos", "Nairobi",
    "Sao Paulo", "Mexico City", "Denver", "Atlanta", "Rotterdam", "Hamburg", "Oslo", "Porto", "Lyon", "Milan", "Vienna",
    "Prague", "Copenhagen", "Helsinki",
)

# Capitalized words that are no name, and words that only begin a sentence.
NO_NAME = frozenset(
    "The This That These Our Their A An Pilot Project New Next Phase Q1 Q2 Q3 Q4 Each Every One Two It We Data Health Labs "
    "Systems Status Summary Notes Team Overview January February March April May June July August September October "
    "November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Today Weekly Daily Quarterly Annual".split()
)
LEADING = frozenset(
    "At In On For From With By And But When After Before During Since While If Both Meanwhile Today Yesterday Also Then Per "
    "Via Unlike Like Once Until As To Of Why How What Which Who Where Does Did Is Was Are".split()
) | NO_NAME - frozenset("Data Health Labs Systems".split())

# Words of a question that point to a type of entity.
TYPE_HINTS = {
    "PROJECT": "project projects initiative pilot program programme product platform",
    "ORGANIZATION": "company companies organization organisation org vendor vendors employer firm startup customer client partner hospital supplier",
    "PERSON": "who whom person people lead leader owner manager engineer sponsor author",
    "TECHNOLOGY": "database language library framework runtime tool tools technology technologies stack broker queue cache caching solver engine store",
    "LOCATION": "where city country office located based depot site",
    "EVENT": "event conference summit offsite meeting talk session",
}

# Abbreviations that a statistical recognizer takes for names, its labels by type of entity, and dates that name no day.
ACRONYMS = frozenset(
    "API APIS GPU GPUS CPU CPUS TPU RAM GB MB TB KB SLA SLO SLI SRE TLS SSL PDF CSV JSON XML HTML HTTP "
    "HTTPS URL URI SQL EHR EMR PHI PII HIPAA GDPR SOC ML AI LLM NLP UI UX QA CI CD PR KPI OKR HR IT ID "
    "SDK ORM VM OS SSO MFA RBAC SIEM REST RPC CEO CTO CFO COO VP PM EM IC SEV ETA FAQ MVP POC RFC ADR".split()
)
RECOGNIZER_LABELS = {"PERSON": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "FAC": "LOCATION", "DATE": "DATE", "EVENT": "EVENT"}
RELATIVE_DATE = (
    r"^(?:today|yesterday|tomorrow|now|daily|weekly|monthly|annually|quarterly|(?:this|last|next|each|every|the)\b.*|"
    r"\d+\s+(?:days?|weeks?|months?|years?).*|(?:a|one|two|three|four|five|six)\s+(?:days?|weeks?|months?|years?).*)$"
)
