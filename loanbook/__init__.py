"""Loan-book risk monitoring on Spark DataFrames."""

from loanbook.book import LoanBook

__all__ = ["LoanBook"]
