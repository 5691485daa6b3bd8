"""quillbank: question-bank analytics and corpus preparation as Spark DataFrame operators."""
