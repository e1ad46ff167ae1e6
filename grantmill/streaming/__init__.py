"""grantmill.streaming"""
