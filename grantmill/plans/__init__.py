"""grantmill.plans"""
