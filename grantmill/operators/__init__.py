"""grantmill.operators"""
