"""The streaming annotation gives the same volume table as the batch job."""

import os
import tempfile

from revlens.operators import textlog
from revlens.streaming import questions


def test_stream_volume_equals_batch(spark, sf_small):
    conv = spark.read.parquet(f"{sf_small}/conversations.parquet")
    base = tempfile.mkdtemp(prefix="revlens-stream-")
    src = os.path.join(base, "in")
    conv.repartition(3).write.parquet(src)
    annotated = questions.question_stream(spark, src, max_files_per_trigger=1)
    q1 = questions.start_annotation_sink(annotated, os.path.join(base, "ann"), os.path.join(base, "ck1"))
    q2 = questions.start_volume_sink(annotated, os.path.join(base, "vol"), os.path.join(base, "ck2"))
    q1.awaitTermination(120)
    q2.awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(os.path.join(base, "vol")).collect()}
    users = conv.where("role = 'user'").select("conv_id", "turn", "text")
    exp = {tuple(r) for r in textlog.question_volume(textlog.annotate_questions(users)).collect()}
    assert got == exp
    assert spark.read.parquet(os.path.join(base, "ann")).count() == users.count()
