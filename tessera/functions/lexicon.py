"""Word lists of the engine.  They are parameters: every function that uses one
takes another in its place."""

from __future__ import annotations

#: Words that carry no topic, for questions and for documents.
STOP_WORDS = tuple(
    """a about above after again all also am an and any are as at be because been before being below between both
    but by can could did do does doing down during each few for from further had has have having he her here hers
    him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our
    out over own same she should so some such than that the their them then there these they this those through to
    too under until up very was we were what when where which while who whom why will with would you your""".split()
)

#: Words that are frequent in prose, though not stop words.
COMMON_WORDS = tuple(
    """back come day even find first get give go good great know last let life like long look made make man many
    may might much must need new next number old one part people place put right said say see seem set show side
    still take tell thing think time try turn two use used want way well word work world year""".split()
)

#: Categories and the keywords that point to them.
TAXONOMY: dict[str, tuple[str, ...]] = {
    "analytics": ("aggregate", "dashboard", "metric", "report", "statistics", "trend"),
    "api": ("endpoint", "graphql", "request", "response", "rest", "webhook"),
    "data": ("dataset", "pipeline", "record", "schema", "table", "warehouse"),
    "database": ("index", "query", "replica", "shard", "sql", "transaction"),
    "deployment": ("cluster", "container", "kubernetes", "release", "rollout", "server"),
    "education": ("course", "lesson", "school", "student", "teacher", "tutorial"),
    "finance": ("account", "budget", "invoice", "market", "payment", "price"),
    "health": ("doctor", "hospital", "medicine", "nutrition", "patient", "therapy"),
    "law": ("contract", "court", "license", "liability", "privacy", "regulation"),
    "learning": ("classifier", "embedding", "gradient", "inference", "model", "training"),
    "science": ("biology", "chemistry", "experiment", "physics", "research", "theory"),
    "security": ("authentication", "certificate", "encryption", "password", "secret", "token"),
    "text": ("document", "grammar", "language", "sentence", "synopsis", "translation"),
    "travel": ("airport", "flight", "hotel", "journey", "station", "ticket"),
}
