"""grantmill.sources"""
