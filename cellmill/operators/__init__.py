"""cellmill.operators"""
