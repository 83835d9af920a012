"""Keyword retrieval must reach the answers of a small corpus: 12 of 15 or more in the top 3."""

from scholia.operators import bm25
from scholia.operators.chunking import chunk_pages, number_chunks

DOCUMENTS = {
    "rivers": """A river begins at its source, often a spring or a melting glacier high in the mountains.
Tributaries are smaller streams that join the main channel and add to its flow.
Where the slope is gentle the water winds in wide loops, and geographers name these loops meanders.
An oxbow lake forms when a meander is cut off from the rest of the channel.

At the mouth the current slows and drops its load of sand and silt, building a delta.
Dams hold back water in reservoirs to generate electricity and to irrigate dry fields.
Floods spread fertile mud over the plain, so early farmers settled close to the banks.
""",
    "music": """A violin has four strings that are tuned in fifths and played with a bow of horsehair.
The piano strikes its strings with felt hammers, so players can vary how loud each note sounds.
Johann Sebastian Bach spent his last years in Leipzig, where he directed the choir of a church.
Ludwig van Beethoven went on composing after he had lost his hearing.

A symphony usually has four movements, of which the second is the slowest.
Jazz grew up in New Orleans around 1900, mixing blues, ragtime and marching bands.
""",
    "stars": """A star shines because hydrogen fuses into helium in its core.
Our sun has burned for about five billion years and has fuel for as many more.
When a massive star runs out of fuel its core collapses and the outer layers explode as a supernova.
The remnant may be a neutron star, which is so dense that a spoonful weighs a billion tonnes.

A light year is the distance that light travels in one year, close to ten trillion kilometres.
Telescopes with large mirrors gather more light and so reveal fainter galaxies.
""",
}
QUESTIONS = [
    ("where does a river begin?", "spring"),
    ("what are streams called that join the main channel?", "Tributaries"),
    ("what do geographers call the wide loops of the water?", "meanders"),
    ("how does an oxbow lake form?", "cut off"),
    ("what is built where the current slows at the mouth?", "delta"),
    ("why do we hold back water with dams?", "electricity"),
    ("how many strings does a violin have?", "four strings"),
    ("what strikes the strings of a piano?", "felt hammers"),
    ("where did Bach direct a choir?", "Leipzig"),
    ("which composer lost his hearing?", "Beethoven"),
    ("where did jazz grow up?", "New Orleans"),
    ("why does a star shine?", "hydrogen fuses"),
    ("what happens when a massive star runs out of fuel?", "supernova"),
    ("how far is a light year?", "ten trillion"),
    ("what do telescopes with large mirrors reveal?", "fainter galaxies"),
]


def test_answers_are_in_the_top_three(spark):
    pages = spark.createDataFrame([(name, "eval", 1, text) for name, text in DOCUMENTS.items()], "document_id string, project_id string, page int, text string")
    chunks = number_chunks(chunk_pages(pages, 60, 12)).select("project_id", "chunk_id", "content").cache()
    content = {r.chunk_id: r.content for r in chunks.collect()}
    asked = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(QUESTIONS)], "query_id int, content string")
    postings, statistics = bm25.build_index(chunks, bm25.english_terms)
    hits: dict[int, list[str]] = {}
    for r in bm25.search(asked, postings, statistics, 3, bm25.english_terms).orderBy("query_id", "rank").collect():
        hits.setdefault(r.query_id, []).append(content[r.chunk_id])
    reached = [any(answer in text for text in hits.get(i, [])) for i, (_, answer) in enumerate(QUESTIONS)]
    first = [bool(hits.get(i)) and answer in hits[i][0] for i, (_, answer) in enumerate(QUESTIONS)]
    assert sum(reached) >= 12, [q for (q, _), ok in zip(QUESTIONS, reached, strict=True) if not ok]
    assert sum(first) >= 12, [q for (q, _), ok in zip(QUESTIONS, first, strict=True) if not ok]
