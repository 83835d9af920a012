import datetime

from pyspark.sql import functions as F

from scholia.operators import requests as R

AT = datetime.datetime(2024, 5, 1, 10)


def test_blank_project_names_are_refused(spark):
    asked = spark.createDataFrame([(1, "  Biology ", " cells "), (2, " \t", "x"), (3, None, None), (4, "Art", None)], "request_id long, name string, description string").withColumn("created_at", F.lit(AT))
    projects, refused = R.new_projects(asked)
    assert {(r.name, r.description) for r in projects.collect()} == {("Biology", "cells"), ("Art", None)}
    assert {(r.request_id, r.reason) for r in refused.collect()} == {(2, R.NO_NAME), (3, R.NO_NAME)}
    again, _ = R.new_projects(asked)
    assert projects.unionByName(again).distinct().count() == 2


def test_sessions_need_a_project(spark):
    projects = spark.createDataFrame([("p1",), ("p1",)], "project_id string")
    asked = spark.createDataFrame([(1, "p1", " Cells "), (2, "p1", ""), (3, "p9", "x"), (4, None, "x")], "request_id long, project_id string, title string").withColumn("created_at", F.lit(AT))
    sessions, refused = R.new_sessions(asked, projects)
    assert {(r.project_id, r.title) for r in sessions.collect()} == {("p1", "Cells"), ("p1", "New chat")}
    assert {(r.request_id, r.reason) for r in refused.collect()} == {(3, "Project not found: p9"), (4, "Project not found: null")}


def test_blank_answers_and_foreign_questions_are_refused(spark):
    questions = spark.createDataFrame([("z", "u", "The cell membrane"), ("y", "v", "Light")], "quiz_id string, question_id string, answer string")
    asked = spark.createDataFrame([(1, "z", "u", "the cell membrane."), (2, "z", "u", " \n"), (3, "z", "v", "Light"), (4, "y", "v", "sound")], "request_id long, quiz_id string, question_id string, student_answer string")
    grades, refused = R.graded_answers(asked, questions)
    assert {(r.request_id, r.correct) for r in grades.collect()} == {(1, True), (4, False)}
    assert {(r.request_id, r.reason) for r in refused.collect()} == {(2, R.NO_ANSWER), (3, "Question not found: v")}


def test_status_counts_states(spark):
    log = [("d1", "p", "PENDING", 1), ("d1", "p", "PROCESSING", 2), ("d1", "p", "READY", 3), ("d2", "p", "PENDING", 1), ("d3", "q", "PENDING", 1), ("d3", "q", "PROCESSING", 2), ("d3", "q", "FAILED", 3), ("d3", "q", "PROCESSING", 4)]
    rows = spark.createDataFrame(log, "document_id string, project_id string, status string, at long")
    got = {r.project_id: (r.pending, r.processing, r.ready, r.failed, r.settled) for r in R.project_status(rows).collect()}
    assert got == {"p": (1, 0, 1, 0, False), "q": (0, 0, 0, 1, True)}
