"""Message classes, orders and intents on sentences with known answers."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import html_blocks, scalar_queries

CLASSES = {
    "identity": ["Comentame, como te sentis?", "¿Cómo te sentís?", "¿Quién sos?", "¿Qué podés hacer?", "¿Tenés sentimientos?", "¿Sos un robot?", "¿Quién te creó?", "Contame de vos", "hola, como te sentis hoy?", "CÓMO TE SENTÍS?", "¿Quién SOS?"],
    "greeting": ["hola", "Gracias!", "dale"],
    "command": ["investiga sobre RAG agéntico", "corre la ingesta", "cual es el status del sistema?"],
    "knowledge": ["Que sabes de GPT6 Astra?", "Podes generar mapas de estudio?", "¿Qué es retrieval augmented generation?", "Quiero aprender sobre Agentic RAG", "Profundiza en Functionary", "mis dudas sobre embeddings", "quiero aprender sobre agentes"],
    "memory": ["que sabes de mi?", "¿Qué sabés de mí?", "te acordás qué hablamos ayer?", "cuales son mis intereses?", "lo que hablamos de RAG"],
    "roadmap": ["donde quedamos", "la proxima unidad"],
}
ORDERS = ["Profundiza en el que consideres más interesante", "Analizá el documento completo", "Leé el documento y contame", "Compará los dos enfoques", "buscá más detalles técnicos"]
NO_ORDERS = ["Que sabes de GPT6 Astra?", "¿Cómo te sentís?", "hola"]
INTENTS = {
    "comparison": ["Compare A versus B", "¿Cuál es la diferencia?"],
    "numeric": ["How many items are there?", "¿Cuántos hay?"],
    "procedural": ["How to install it", "¿Cómo se hace?"],
    "evidence": ["What evidence is there", "según la fuente"],
    "document_reading": ["What does the paper say"],
    "explanation": ["Why is it so", "¿Por qué?"],
    "informational": ["Nothing special here"],
}


def _values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("kind", CLASSES)
def test_message_classes(spark, kind):
    assert _values(spark, CLASSES[kind], scalar_queries.message_class("t")) == [kind] * len(CLASSES[kind])


def test_orders(spark):
    order = T.strip_accents(F.lower("t")).rlike(scalar_queries.IMPERATIVE)
    assert all(_values(spark, ORDERS, order)) and not any(_values(spark, NO_ORDERS, order))


@pytest.mark.parametrize("kind", INTENTS)
def test_intents(spark, kind):
    assert _values(spark, INTENTS[kind], scalar_queries.intent("t")) == [kind] * len(INTENTS[kind])


def test_languages(spark):
    assert _values(spark, ["what is the source of it", "¿Cuál es la fuente?", "zzz"], scalar_queries.language("t")) == ["en", "es", "und"]


@pytest.mark.parametrize("tag", sorted(html_blocks.INCLUDED))
def test_each_content_element_gives_a_block(tag):
    page = f"<html><body><{tag}>five words of plain content here</{tag}></body></html>"
    assert any("five words of plain content here" in text for text, *_ in html_blocks.blocks(page))


ENTITIES = {
    'What did "Deep Blue" do': ["Deep Blue", "Deep", "Blue"],
    'say " 0 spaced " and "1 more 1"': ["0 spaced", "1 more 1"],
    "How does NASA use GPT-4 and R2D2, or the Apollo missions?": ["NASA", "GPT-4", "R2D2", "Apollo"],
    "Nothing here": [],
    "the AT&T report of Berlin. berlin": ["AT&T", "Berlin"],
    "": [],
}


@pytest.mark.parametrize("question", ENTITIES)
def test_entities(spark, question):
    assert _values(spark, [question], scalar_queries.entities("t")) == [ENTITIES[question]]
