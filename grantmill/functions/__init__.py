"""grantmill.functions"""
