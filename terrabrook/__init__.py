"""Terrabrook: satellite field analytics and corpus preparation as Spark DataFrame operators."""
