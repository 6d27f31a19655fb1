"""faultlens.operators"""
